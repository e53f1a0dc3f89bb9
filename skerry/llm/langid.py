"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (1 to 3 of letters and word ends), log-scaled, weighted by inverse document frequency and normalised. Each language has CENTROIDS centroids, found by spherical k-means over all its labelled texts, and a text gets the language of the centroid of greatest cosine, which is the score. A text that is farther from all centroids than nearly all training texts are from their own is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import drop_path, new_path, stage_at
from .tokens import release

#: k-means ends when nothing changes, after ROUNDS rounds at the latest.
DIMS, CENTROIDS, ROUNDS, MARGIN = 4096, 4, 12, 0.5
#: Vectors are summed in units of 1 / UNIT, as whole numbers, so that sums don't depend on their order; a task gives its sums on in slices of SLICE places.
UNIT, SLICE = 1 << 30, 128


_letters = None


def _letter_table():
    """1 for code points that are letters."""
    global _letters
    if _letters is None:
        import numpy as np

        _letters = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str | None):
    """Counts of DIMS hashed n-grams of the whole text, or None if it has no letter."""
    import numpy as np

    if not text:
        return None
    table, counts = _letter_table(), np.zeros(DIMS, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = table[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    codes = np.concatenate([np.array([32], np.uint32), codes, np.array([32], np.uint32)])
    one, two, three = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
    for k in range(0, len(codes), 1 << 20):
        c = codes[k : k + (1 << 20) + 2]
        h1 = c * one
        h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * two + c[1:]
        h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * three + c[2:]
        own = min(len(c), 1 << 20)
        for h in (h1[:own], h2[:own], h3[:own]):
            counts += np.bincount((h * one) >> np.uint32(20), minlength=DIMS)
    return counts


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: object  # centroids x DIMS, float32, unit rows
    idf: object
    least: float  # texts of a smaller cosine are rejected

    def vectors(self, counts):
        import numpy as np

        v = np.log1p(counts.astype(np.float32)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, counts) -> list[tuple[str, float]]:
        import numpy as np

        cos = np.clip(self.vectors(counts) @ self.centroids.T, 0, 1)
        best = cos.argmax(axis=1)
        return [(self.languages[b], float(cos[k, b])) for k, b in enumerate(best)]


def held_out(doc_id: Column) -> Column:
    """The rows that no fit sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _packed(counts) -> tuple[bytes, bytes, bytes]:
    """Places of the n-grams that there are, in 16 bits each; their counts, in a byte each; and in 64 bits each, those above 254, which have byte 255."""
    import numpy as np

    at = np.flatnonzero(counts)
    n = counts[at]
    return at.astype("<u2").tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n > 254].astype("<i8").tobytes()


def _unpacked(places: list[bytes], counts: list[bytes], above: list[bytes]):
    """Of packed texts: the row, place and count of each n-gram that there is, and where each row begins."""
    import numpy as np

    sizes = np.fromiter(map(len, counts), np.int64, len(counts))
    n = np.frombuffer(b"".join(counts), np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(b"".join(above), "<i8")
    return np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(b"".join(places), "<u2").astype(np.int64), n, np.cumsum(sizes) - sizes


def _units(packed, idf):
    """As _unpacked, with the entries of unit vectors for counts."""
    import numpy as np

    rows, at, n, starts = _unpacked(*packed)
    v = (np.log1p(n.astype(np.float32)) * idf[at]).astype(np.float64)
    v /= np.sqrt(np.add.reduceat(v * v, starts))[rows]
    return rows, at, v, starts


def _cosines(own, rows, at, v, starts, c):
    """Cosines of rows with the centroids c (centroids x languages x DIMS) of their own language."""
    import numpy as np

    place = (own * DIMS)[rows] + at
    return np.stack([np.add.reduceat(v * k.reshape(-1)[place], starts) for k in c], axis=1)


def _counted(train: DataFrame) -> DataFrame:
    """Of train (text, lang, h): a row (lang, h, places, counts, above) for each text with a letter, and one for each task, with frequencies alone, that counts the texts that have each n-gram, the last number being that of all texts with a letter."""
    import pyarrow as pa

    kinds = {"lang": pa.string(), "h": pa.int64(), "places": pa.binary(), "counts": pa.binary(), "above": pa.binary(), "frequencies": pa.list_(pa.int64())}

    def run(batches):
        import numpy as np

        release()
        frequencies = np.zeros(DIMS + 1, np.int64)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = []
                for t, lang, h in zip(*b.slice(k, 256).columns, strict=True):
                    counts = ngram_counts(t.as_py())
                    if counts is not None:
                        frequencies[:-1] += counts > 0
                        frequencies[-1] += 1
                        rows.append((lang.as_py(), h.as_py(), *_packed(counts), None))
                if rows:
                    yield batch(rows)
        yield batch([(None, None, None, None, None, frequencies)])

    return train.select("text", "lang", "h").mapInArrow(run, "lang string, h long, places binary, counts binary, above binary, frequencies array<long>")


def _sums(texts: DataFrame, languages: list[str], idf, c):
    """Sums of the texts' unit vectors, in units of 1 / UNIT, by the nearest of c's centroids of their own language; without c by language alone. (centroids x languages x DIMS)"""
    import numpy as np

    many = 1 if c is None else len(c)
    known = texts.sparkSession.sparkContext.broadcast(({x: k for k, x in enumerate(languages)}, idf, c))

    def given(sums):
        import pyarrow as pa

        slices = [(key, k, x) for key, s in sums.items() for k, x in enumerate(s.reshape(-1, SLICE)) if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in slices], pa.int64()), pa.array([x[1] for x in slices], pa.int64()), pa.array([x[2].tobytes() for x in slices], pa.binary())], ["centroid", "slice", "sums"])

    def of_task(batches):
        release()
        index, idf, c = known.value
        sums = {}
        for b in batches:
            for k in range(0, b.num_rows, 256):
                lang, *packed = (x.to_pylist() for x in b.slice(k, 256).columns)
                own = np.array([index[x] for x in lang])
                rows, at, v, starts = _units(packed, idf)
                to = own if c is None else _cosines(own, rows, at, v, starts, c).argmax(axis=1) * len(index) + own
                keys, nth = np.unique(to, return_inverse=True)
                found = np.bincount(nth[rows] * DIMS + at, np.rint(v * UNIT), len(keys) * DIMS).astype(np.int64).reshape(-1, DIMS)
                for key, x in zip(keys.tolist(), found, strict=True):
                    sums[key] = sums[key] + x if key in sums else x
                if len(sums) > 512:
                    yield given(sums)
                    sums = {}
        if sums:
            yield given(sums)

    def of_all(batches):
        sums = {}
        for b in batches:
            for centroid, k, x in zip(*(x.to_pylist() for x in b.columns), strict=True):
                x = np.frombuffer(x, np.int64)
                sums[centroid, k] = sums[centroid, k] + x if (centroid, k) in sums else x
        if sums:
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["centroid", "slice", "sums"])

    kinds = "centroid long, slice long, sums binary"
    out = np.zeros((many * len(languages), DIMS // SLICE, SLICE), np.int64)
    for r in texts.select("lang", "places", "counts", "above").mapInArrow(of_task, kinds).repartition("centroid", "slice").mapInArrow(of_all, kinds).collect():  # what the model has, in 64 bits
        out[r.centroid, r.slice] = np.frombuffer(r.sums, np.int64)
    known.unpersist()
    return out.reshape(many, len(languages), DIMS)


def _farthest(texts: DataFrame, languages: list[str], idf, c, nearest: bool = False):
    """Of each language, the unit vector of the text whose greatest cosine with c's centroids of its language is least, and 1 less this cosine; or greatest, if nearest. Ties go to the smallest h."""
    import numpy as np

    known = texts.sparkSession.sparkContext.broadcast(({x: k for k, x in enumerate(languages)}, idf, c))

    def of_task(batches):
        import pyarrow as pa

        release()
        index, idf, c = known.value
        best = {}
        for b in batches:
            for k in range(0, b.num_rows, 256):
                lang, h, *packed = (x.to_pylist() for x in b.slice(k, 256).columns)
                own = np.array([index[x] for x in lang])
                cos = _cosines(own, *_units(packed, idf), c).max(axis=1)
                cos = -cos if nearest else cos
                order = np.lexsort((np.array(h), cos, own))
                for i in order[np.unique(own[order], return_index=True)[1]].tolist():
                    new = (float(cos[i]), h[i], *(x[i] for x in packed))
                    if lang[i] not in best or new[:2] < best[lang[i]][:2]:
                        best[lang[i]] = new
        if best:
            columns = zip(*((x, *y) for x, y in best.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["lang", "cos", "h", "places", "counts", "above"])

    found = texts.select("lang", "h", "places", "counts", "above").mapInArrow(of_task, "lang string, cos double, h long, places binary, counts binary, above binary")
    out, far, at = np.zeros((len(languages), DIMS)), np.zeros(len(languages)), {x: k for k, x in enumerate(languages)}
    for r in found.groupBy("lang").agg(F.min(F.struct("cos", "h", "places", "counts", "above")).alias("best")).select("lang", "best.*").collect():  # a row a language
        _, places, v, _ = _units(([r.places], [r.counts], [r.above]), idf)
        out[at[r.lang], places], far[at[r.lang]] = v, 1 - r.cos
    known.unpersist()
    return out, far


def _directions(sums, else_):
    """Sums as unit rows; else_ where there is no sum."""
    import numpy as np

    norms = np.linalg.norm(sums.astype(np.float64), axis=-1, keepdims=True)
    return np.where(norms > 0, sums / np.maximum(norms, 1e-9), else_).astype(np.float32)


def _centroids(texts: DataFrame, languages: list[str], idf, most: int):
    """Spherical k-means of all texts of each language at once (centroids x languages x DIMS). It starts with the text that is nearest to their mean, and then with the text farthest from those taken so far, as long as it differs from them; the rows of centroids that a language doesn't have are zero."""
    import numpy as np

    mean = _directions(_sums(texts, languages, idf, None), 0)
    c = _farthest(texts, languages, idf, mean, nearest=True)[0][None].astype(np.float32)
    while len(c) < most:
        text, far = _farthest(texts, languages, idf, c)
        if far.max() < 1e-6:
            break
        c = np.concatenate([c, np.where(far[:, None] < 1e-6, 0, text)[None].astype(np.float32)])
    for _ in range(ROUNDS):
        before, c = c, _directions(_sums(texts, languages, idf, c), c)
        if np.array_equal(before, c):
            break
    return c


def _percentile(values: DataFrame, part: float) -> float:
    """The exact percentile, interpolated, of numbers from 0 to 1 that have few digits, as those of 32 bits have. Counts of 65,537 ranges tell which to look into."""
    import math

    ranged = values.select(F.col(values.columns[0]).alias("x"), F.floor(F.col(values.columns[0]) * 65536).alias("range"))
    counts = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())
    place, found, before = part * (sum(n for _, n in counts) - 1), [], 0
    for k, n in counts:
        if before <= math.ceil(place) and before + n > math.floor(place):
            found.append((k, before))
        before += n
    at = {}
    for k, before in found:
        for x, n in sorted((r["x"], r["count"]) for r in ranged.filter(F.col("range") == k).groupBy("x").count().collect()):
            for p in (math.floor(place), math.ceil(place)):
                if before <= p < before + n:
                    at[p] = x
            before += n
    low, high = at[math.floor(place)], at[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


def fit(documents: DataFrame, centroids: int = CENTROIDS) -> Model | None:
    """Learns from text and non-null lang of documents (doc_id, text, lang) that aren't held out, from all of them: languages, document frequencies, centroids and the least cosine. A row that repeats counts as often as it is there. N-grams are counted once and staged in 3 bytes for each that a text has; each step of k-means reads them again. The model has at most `centroids` rows of DIMS numbers a language, in the driver's memory. None if there is nothing to learn from."""
    import numpy as np

    spark = documents.sparkSession
    train = documents.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64(F.lit(5), "doc_id", "text").alias("h"))
    made = [new_path(spark, "ngrams"), new_path(spark, "nearest")]
    found = stage_at(_counted(train), made[0])
    seen = [0] * (DIMS + 1)
    for r in found.filter("lang is null").select(F.posexplode("frequencies").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():  # DIMS rows
        seen[r.k] = r.n
    if not seen[-1]:
        drop_path(spark, made[0])
        return None
    texts = found.filter("lang is not null")
    languages = sorted(r.lang for r in texts.select("lang").distinct().collect())
    model = Model([], None, (np.log((1 + seen[-1]) / (1 + np.array(seen[:-1]))) + 1).astype(np.float32), 0.0)
    c = _centroids(texts, languages, model.idf, centroids).transpose(1, 0, 2)
    there = c.any(axis=2)
    model.languages = [x for k, x in enumerate(languages) for _ in range(there[k].sum())]
    model.centroids = np.ascontiguousarray(c[there])
    known = spark.sparkContext.broadcast(model)

    def nearest(batches):
        import pyarrow as pa

        release()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows, at, n, starts = _unpacked(*(x.to_pylist() for x in b.slice(k, 256).columns))
                counts = np.zeros((len(starts), DIMS), np.int64)
                counts[rows, at] = n
                yield pa.RecordBatch.from_arrays([pa.array([x for _, x in known.value.predict(counts)], pa.float64())], ["best"])

    model.least = _percentile(stage_at(texts.select("places", "counts", "above").mapInArrow(nearest, "best double"), made[1]), 0.005) * MARGIN
    for path in made:
        drop_path(spark, path)
    return model


def identify(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) and the columns `keep` for each row of documents (doc_id, text).

    lang_pred is the nearest centroid's language whether or not the text is rejected; it is "und", with score 0 and rejected, if the text is null, has no letter, or there is no model. Rows that repeat are judged alike; a null doc_id isn't held out; an empty table gives an empty table; other columns are left alone.
    """
    import pyarrow as pa

    known = documents.sparkSession.sparkContext.broadcast(model)  # CENTROIDS rows of DIMS numbers a language
    asked = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), *keep, "text")
    names = [*asked.columns[:-1], "lang_pred", "score", "rejected"]

    def run(batches):
        import numpy as np

        release()
        m = known.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                counts = [ngram_counts(t.as_py()) if m else None for t in part.columns[-1]]
                there = [i for i, c in enumerate(counts) if c is not None]
                said = [("und", 0.0, True)] * part.num_rows
                if there:
                    for i, (lang, score) in zip(there, m.predict(np.stack([counts[i] for i in there])), strict=True):
                        said[i] = (lang, score, score < m.least)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array([s[j] for s in said], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]], names)

    fields = [*asked.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return asked.mapInArrow(run, StructType(fields))


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
