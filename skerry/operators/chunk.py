"""Chunkers, symbol extraction and hashed embeddings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions.paths import file_type
from ..functions.text import embedding_tokens, trimmed

CHUNK_LINES, DIM = 20, 384
# What opens a declaration.
PREFIXES = (
    "fn ", "async fn ", "pub fn ", "pub async fn ", "pub(crate) fn ", "pub(crate) async fn ", "pub(super) fn ", "pub(super) async fn ", "pub(self) fn ", "pub(self) async fn ",
    "public class ", "private class ", "protected class ", "class ", "abstract class ", "public interface ", "private interface ", "protected interface ", "interface ",
    "def ", "async def ", "pub struct ", "pub(crate) struct ", "pub(super) struct ", "pub(self) struct ", "struct ",
    "pub enum ", "pub(crate) enum ", "pub(super) enum ", "pub(self) enum ", "public enum ", "private enum ", "protected enum ", "enum ",
    "pub trait ", "pub(crate) trait ", "pub(super) trait ", "pub(self) trait ", "trait ",
    "const ", "let ", "export const ", "export let ", "function ", "export async function ", "export function ", "export default function ", "export default async function ",
)
KINDS = (("class ", "class"), ("interface ", "trait"), ("struct ", "struct"), ("enum ", "enum"), ("trait ", "trait"), ("const ", "const"))
CONTROL = ("if", "for", "while", "switch", "catch", "return", "else", "match")


def _regex(s: str) -> str:
    return "".join("\\" + c if c in "()[]{}.*+?^$|\\" else c for c in s)


#: No opening is a prefix of another, so their order is free and one alternation does.
DECLARATION = "^(?:" + "|".join(_regex(p) for p in PREFIXES) + r")([^({: =]+)"


def lines_of(content: Column) -> Column:
    """Lines without their ends; a last empty line is none."""
    return F.split(F.regexp_replace(content, r"\r?\n\z", ""), "\r?\n", -1)


def chunk_paragraphs(files: DataFrame) -> DataFrame:
    parts = files.select("path", F.posexplode(F.split("content", "\n\n", -1)).alias("i", "content"))
    return parts.select("path", F.concat(F.lit("txt:"), F.col("i").cast("string")).alias("chunk_id"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), trimmed(F.col("content")).alias("content"), F.lit(None).cast("string").alias("symbol")).filter("content <> ''")


def text_samples(files: DataFrame, n: int, least: int = 20, most: int = 1200) -> DataFrame:
    """The first n paragraphs, by path and place, of at least `least` bytes, of files that hold text, each as its first `most` characters: what an embedder is tried on."""
    kinds = F.col("path").rlike(r"(?i)\.(rs|py|ts|tsx|js|jsx|java|go|md|txt|toml|yaml|yml|json)$")
    parts = files.filter(kinds).select("path", F.posexplode(F.split("content", "\n\n", -1)).alias("place", "raw")).select("path", "place", trimmed(F.col("raw")).alias("sample"))
    return parts.filter(F.octet_length("sample") >= least).orderBy("path", "place").limit(n).select("path", "place", F.substring("sample", 1, most).alias("sample"))


def chunk_lines(files: DataFrame, n: int = CHUNK_LINES) -> DataFrame:
    """Windows of max(20, n) lines that don't overlap; lines count from 1."""
    n = max(20, n)
    cut = files.select("path", lines_of(F.col("content")).alias("ls")).select("path", "ls", F.explode(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / F.lit(n)).cast("int"))).alias("w"))
    start, end = F.col("w") * n + 1, F.least((F.col("w") + 1) * n, F.size("ls"))
    return cut.select("path", F.concat(F.lit("chunk:"), start.cast("string"), F.lit(":"), end.cast("string")).alias("chunk_id"), start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice("ls", start, F.lit(n)), "\n").alias("content"), F.lit(None).cast("string").alias("symbol"))


def chunk_config(files: DataFrame) -> DataFrame:
    """A chunk a line that is neither blank nor a comment; symbol is its key."""
    rows = files.select("path", F.posexplode(lines_of(F.col("content"))).alias("i", "line")).withColumn("content", trimmed(F.col("line"))).filter("content <> '' and content not like '#%'")
    sep = F.when(F.instr("content", "=") > 0, "=").when(F.instr("content", ":") > 0, ":")
    key = F.when(sep == "=", trimmed(F.substring_index("content", "=", 1))).when(sep == ":", trimmed(F.substring_index("content", ":", 1)))
    return rows.select("path", F.concat(F.lit("cfg:"), (F.col("i") + 1).cast("string")).alias("chunk_id"), (F.col("i") + 1).alias("start_line"), (F.col("i") + 1).alias("end_line"), "content", key.alias("symbol"))


def chunks_all(files: DataFrame, n: int = CHUNK_LINES) -> DataFrame:
    typed = files.withColumn("file_type", file_type(F.col("path")))
    of = lambda *t: typed.filter(F.col("file_type").isin(*t))
    return chunk_paragraphs(of("markdown", "text")).unionByName(chunk_config(of("json", "yaml", "toml"))).unionByName(chunk_lines(of("code"), n))


def extract_symbols(files: DataFrame) -> DataFrame:
    """Declarations of code files: (path, symbol_name, symbol_kind, line_start, exported)."""
    code = files.filter(file_type(F.col("path")) == "code").select("path", F.posexplode(lines_of(F.col("content"))).alias("i", "raw")).select("path", (F.col("i") + 1).alias("line_start"), trimmed(F.col("raw")).alias("line"))
    named = F.regexp_extract("line", DECLARATION, 1)
    before = trimmed(F.substring_index("line", "(", 1))
    last = F.regexp_extract(before, r"(\S+)$", 1)
    typed = F.col("line").rlike(r"\(") & ~F.col("line").rlike("^//") & ~before.rlike("=") & F.col("line").rlike(r"(\{|=>|=>;|;)$") & before.rlike(r"\S\s+\S") & ~F.regexp_extract(before, r"^(\S+)", 1).isin(*CONTROL) & ~last.isin(*CONTROL) & last.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    kind = None
    for needle, k in KINDS:
        hit = F.contains("line", F.lit(needle))
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
    out = code.select("path", F.when(named != "", named).when(typed, last).alias("symbol_name"), kind.otherwise("function").alias("symbol_kind"), "line_start", F.col("line").rlike(r"^(pub |pub\(|export )").alias("exported"))
    return out.filter("symbol_name is not null")


def bucket(token: Column, dim: int = DIM) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def _bucket_counts(rows: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    return rows.select(key, F.explode(embedding_tokens(F.col(text))).alias("t")).groupBy(key, bucket(F.col("t"), dim).alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def hash_embed(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """Sparse unit vectors: (key, bucket, weight), weights the token counts of a bucket over their norm."""
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return _bucket_counts(rows, key, text, dim).select(key, "bucket", (F.col("n") / norm).alias("weight"))


def hash_embed_packed(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """The same, a row a vector: (key, buckets, weights)."""
    v = _bucket_counts(rows, key, text, dim).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("v"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))  # at most dim buckets
    return v.select(key, F.col("v.bucket").alias("buckets"), F.transform("v.n", lambda n: n / F.col("norm")).alias("weights"))


def embed(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], dim: int, batch: int = 64) -> DataFrame:
    """(key, embedding): unit vectors of dim numbers by a model, which each worker loads once and calls with `batch` texts at a time; longer vectors are cut, shorter ones filled with zeros, before they are normalised. A null text has no vector, nor has one whose vector is all zeros."""
    import pyarrow as pa

    kind = rows.schema[key].dataType

    def run(batches):
        import numpy as np

        model = load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch).filter(b.slice(at, batch).column(1).is_valid())
                if not part.num_rows:
                    continue
                out = np.zeros((part.num_rows, dim), np.float32)
                for row, v in zip(out, model(part.column(1).to_pylist()), strict=True):
                    v = np.asarray(v, np.float32)[:dim]
                    row[: len(v)] = v
                norm = np.linalg.norm(out, axis=1)
                some = np.flatnonzero(norm > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(list(out[some] / norm[some, None]), pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, text).mapInArrow(run, StructType([StructField(key, kind), StructField("embedding", ArrayType(FloatType()))]))
