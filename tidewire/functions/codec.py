"""Payload codecs. Decoding never fails a job: bad bytes give a NULL struct.

``JsonCodec`` runs everywhere. ``ProtobufCodec`` uses Spark's own functions and
needs the spark-protobuf package.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.registry import StreamSpec

_CORRUPT = "_corrupt"


def payload_type(spec: StreamSpec) -> T.StructType:
    return T.StructType.fromDDL(spec.fields)


def one_json_value(text: Column) -> Column:
    """Whether a text is one JSON value with nothing but white space around it.

    The parser stops at the end of a value. So the text is put into a list and into an
    object: text behind the value that closes the one, or goes on in it, breaks the other.
    """
    listed = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    keyed = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))) == 1
    return F.coalesce(listed & keyed, F.lit(False))


@dataclass(frozen=True)
class JsonCodec:
    """JSON objects as UTF-8 bytes."""

    def decode(self, df: DataFrame, value: str, spec: StreamSpec, out: str = "payload") -> DataFrame:
        fields = payload_type(spec)
        wire = T.StructType([*fields.fields, T.StructField(_CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        # Two steps, so that the text is parsed once per row: the second only reads fields.
        kept = df.withColumn(f"_text_{value}", F.col(value).cast("string"))
        parsed = kept.withColumn(out, F.from_json(F.col(f"_text_{value}"), wire, options))
        whole = F.col(out).isNotNull() & F.col(out)[_CORRUPT].isNull() & one_json_value(F.col(f"_text_{value}"))
        return parsed.withColumn(out, F.when(whole, F.struct(*[F.col(out)[f].alias(f) for f in fields.names]))).drop(
            f"_text_{value}"
        )

    def encode(self, payload: Column, spec: StreamSpec) -> Column:
        return F.to_json(payload).cast("binary")


@dataclass(frozen=True)
class ProtobufCodec:
    """Protobuf through ``from_protobuf``; one descriptor set serves all messages."""

    descriptor: bytes

    def options(self) -> dict[str, str]:
        return {"mode": "PERMISSIVE", "emit.default.values": "true"}

    def decode(self, df: DataFrame, value: str, spec: StreamSpec, out: str = "payload") -> DataFrame:
        from pyspark.sql.protobuf.functions import from_protobuf

        decoded = from_protobuf(
            F.col(value), spec.message, options=self.options(), binaryDescriptorSet=self.descriptor
        )
        return df.withColumn(out, decoded)

    def encode(self, payload: Column, spec: StreamSpec) -> Column:
        from pyspark.sql.protobuf.functions import to_protobuf

        return to_protobuf(payload, spec.message, binaryDescriptorSet=self.descriptor)
