"""The shape of a record: how many values, and how each lies on disk."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from .errors import InvalidRecordShape

#: Of any frame of records: where each comes from, its place in the whole, and its values, inputs before outputs.
RECORDS = T.StructType([
    T.StructField("file_ord", T.IntegerType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("rec_idx", T.LongType(), False),
    T.StructField("pos", T.LongType(), False),
    T.StructField("values", T.ArrayType(T.FloatType(), False), False),
])


class Encoding(Enum):
    FLOAT32 = "float32"
    BFLOAT16 = "bfloat16"

    @property
    def width(self) -> int:
        return 4 if self is Encoding.FLOAT32 else 2


@dataclass(frozen=True)
class RecordShape:
    inputs: int
    outputs: int
    encoding: Encoding = Encoding.FLOAT32

    def __post_init__(self):
        if self.inputs < 1 or self.outputs < 1:
            raise InvalidRecordShape(inputs=self.inputs, outputs=self.outputs)

    @property
    def values(self) -> int:
        return self.inputs + self.outputs

    @property
    def bytes_per_record(self) -> int:
        return self.values * self.encoding.width

    def encoded(self, encoding: Encoding) -> RecordShape:
        return RecordShape(self.inputs, self.outputs, encoding)

    def as_dict(self) -> dict:
        return {
            "inputs": self.inputs, "outputs": self.outputs, "record_values": self.values,
            "bytes_per_record": self.bytes_per_record, "encoding": self.encoding.value,
        }
