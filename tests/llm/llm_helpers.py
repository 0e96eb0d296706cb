"""Plain Python counterparts that tests compare with."""

import re


def rows_of(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def real_docs(spark, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/documents.parquet")
