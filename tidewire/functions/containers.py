"""Container log lines and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JSON line format, and the file name of a container's log.
DOCKER_FIELDS = "log STRING, stream STRING, time STRING"
LOG_FILE = r"[^/_]+_[^/_]+_[^/]+-[0-9a-f]{64}\.log$"
ID_LENGTH = len("-.log") + 64


def parse_line(line: Column) -> Column:
    """``struct<ts, stream, partial, log>`` of a raw line; NULL when it is neither format.

    Runtime lines read ``time stream flags text`` with flag P for a piece that
    goes on; the older format is a JSON object whose text ends with a newline
    unless it goes on.
    """
    docker = F.from_json(line, DOCKER_FIELDS)
    whole = docker["log"].endswith("\n")
    text = F.when(whole, F.substr(docker["log"], F.lit(1), F.length(docker["log"]) - 1)).otherwise(docker["log"])
    from_docker = F.struct(
        F.try_to_timestamp(docker["time"]).alias("ts"),
        docker["stream"].alias("stream"),
        (~whole).alias("partial"),
        text.alias("log"),
    )
    # Time, stream and flags have no spaces; the rest is the text.
    words = F.split(line, " ", 4)
    is_cri = F.get(words, F.lit(1)).isin("stdout", "stderr") & (F.size(words) >= 3)
    from_cri = F.struct(
        F.try_to_timestamp(words[0]).alias("ts"),
        words[1].alias("stream"),
        F.array_contains(F.split(words[2], ":"), "P").alias("partial"),
        F.coalesce(F.get(words, F.lit(3)), F.lit("")).alias("log"),
    )
    return F.when(line.startswith("{") & docker["log"].isNotNull(), from_docker).when(is_cri, from_cri)


def pod_of(path: Column) -> list[Column]:
    """``namespace, pod_name, container`` from the name of a log file; NULL when it has another form."""
    words = F.split(F.substring_index(path, "/", -1), "_", 3)
    container = F.left(words[2], F.length(words[2]) - ID_LENGTH)
    parts = {"namespace": words[1], "pod_name": words[0], "container": container}
    return [F.when(path.rlike(LOG_FILE), part).alias(name) for name, part in parts.items()]
