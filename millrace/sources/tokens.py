"""Token files, vocabularies, checkpoints."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from millrace.functions import text as tx

#: The largest id that two bytes hold.
MAX_ID = 65_535


@F.pandas_udf(BinaryType())
def to_uint16(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ids as two bytes each, the lower first; an id that doesn't fit is an error."""
    for series in ids:
        yield series.map(_bytes)


def _bytes(ids) -> bytes | None:
    if ids is None:
        return None
    a = np.asarray(ids, np.int64)
    if len(a) and (a.min() < 0 or a.max() > MAX_ID):
        raise ValueError(f"an id is outside 0..{MAX_ID}")
    return a.astype("<u2").tobytes()


@F.pandas_udf(ArrayType(IntegerType()))
def from_uint16(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in data:
        yield series.map(lambda x: None if x is None else np.frombuffer(bytes(x), "<u2").astype(np.int32))


def write_token_table(tokens: DataFrame, path: str) -> None:
    """doc_id, ids (two bytes each) as Parquet, sorted by id within files of ranges of ids."""
    rows = tokens.select("doc_id", to_uint16("ids").alias("ids"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", from_uint16("ids").alias("ids"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """path, ids of raw files of two-byte ids."""
    return spark.read.format("binaryFile").load(path).select("path", from_uint16("content").alias("ids"))


def write_vocabulary(spark: SparkSession, path: str, vocab: dict[int, bytes], merges: list[tuple[bytes, bytes]]) -> None:
    """Tables vocab (token_id, token) and merges (rank, left, right)."""
    spark.createDataFrame([(i, bytearray(t)) for i, t in vocab.items()], "token_id int, token binary").write.mode("overwrite").parquet(f"{path}/vocab")
    rows = [(k, bytearray(a), bytearray(b)) for k, (a, b) in enumerate(merges)]
    spark.createDataFrame(rows, "rank int, left binary, right binary").write.mode("overwrite").parquet(f"{path}/merges")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    vocab = {r["token_id"]: bytes(r["token"]) for r in spark.read.parquet(f"{path}/vocab").collect()}
    merges = [(bytes(r["left"]), bytes(r["right"])) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return vocab, merges


def read_printable(spark: SparkSession, vocab_json: str, merges_txt: str) -> tuple[dict[int, bytes], list[tuple[bytes, bytes]]]:
    """Vocabulary and merges from a JSON map and a list of pairs in printable signs. Lines that start with #version,
    blank lines and lines of other than two fields are left out."""
    entries = spark.read.text(vocab_json, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id"))
    vocab = {r["id"]: bytes(r["token"]) for r in entries.select("id", tx.from_signs(F.col("token")).alias("token")).collect()}
    signs = {s: b for b, s in tx.byte_signs().items()}
    merges = []
    for (line,) in spark.read.text(merges_txt, wholetext=True).collect():
        for fields in (x.split(" ") for x in line.split("\n") if x.strip() and not x.startswith("#version")):
            if len(fields) == 2 and all(fields):
                merges.append(tuple(bytes(signs[c] for c in f) for f in fields))
    return vocab, merges


@dataclass
class Paths:
    """Where a run reads and writes; none has a default."""

    train: str
    valid: str
    out: str


@dataclass
class ModelConfig:
    vocab: int = 50_257
    context: int = 1024
    width: int = 768
    layers: int = 12
    heads: int = 12
    hidden: int = 3072
    theta: float = 10_000.0


@dataclass
class Training:
    batch_size: int = 32
    steps: int = 1_000
    learning_rate: float = 1e-3
    seed: int = 0


@dataclass
class RunConfig:
    """Settings of a training run in three groups."""

    paths: Paths
    model: ModelConfig = field(default_factory=ModelConfig)
    training: Training = field(default_factory=Training)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "RunConfig":
        """Groups that are missing take their defaults; a name that no group has is an error."""
        groups = json.loads(text)
        kinds = {"paths": Paths, "model": ModelConfig, "training": Training}
        if unknown := set(groups) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: kinds[k](**v) for k, v in groups.items()})


def save_pretrained(spark: SparkSession, config: ModelConfig, weights: dict[str, np.ndarray], path: str) -> None:
    """A model as a folder: its configuration and its weights."""
    spark.createDataFrame([(json.dumps(asdict(config), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    rows = [(name, list(w.shape), bytearray(np.ascontiguousarray(w, "<f8").tobytes())) for name, w in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").write.mode("overwrite").parquet(f"{path}/weights")


def from_pretrained(spark: SparkSession, path: str) -> tuple[ModelConfig, dict[str, np.ndarray]]:
    """Configuration and weights of a folder. Prefixes that compiled models put before names go."""
    config = ModelConfig(**json.loads(spark.read.text(f"{path}/config").first()["value"]))
    rows = spark.read.parquet(f"{path}/weights").withColumn("name", plain_name(F.col("name"))).collect()  # one row for each weight
    return config, {r["name"]: np.frombuffer(bytes(r["data"]), "<f8").reshape(r["shape"]).copy() for r in rows}


def plain_name(name: Column) -> Column:
    """A parameter's name without the prefix that compiled models put before it."""
    return F.regexp_replace(name, r"^.*_orig_mod\.", "")
