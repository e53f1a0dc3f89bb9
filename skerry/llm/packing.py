"""Best-fit packing of documents into sequences by bin completion with branch and bound.

How documents can be packed depends on their lengths alone, and a length is at most `size`. So the corpus is reduced to a histogram of lengths, at most `size` rows however large it is, which the driver packs. Best fit decreasing over the whole histogram is the first incumbent. The search then takes the largest length left and enumerates undominated fillings of the rest of its sequence, uses one as often as the counts allow, and so on; a branch ends where its waste rules out fewer sequences than the incumbent has. It is begun anew for each of POWERS, which order fillings by the sum of their lengths' powers: 1 is best fit, a greater power keeps small documents for later. What comes back is a list of filling patterns with multiplicities; the documents of each length are then numbered, in parallel, and dealt to the patterns in that order.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stage
from .tokens import CACHE, default_vocabulary, encoder

SIZE, NODES, FILLINGS, TRIES = 2048, 2_000, 6, 24
POWERS = (1.0, 2.0, 4.0, 8.0, 0.5)
#: Items that one task numbers, about: not more than PART_ROWS, and of fewer items what a shuffle's partition has, but LEAST_ROWS.
PART_ROWS, LEAST_ROWS = 1 << 18, 1 << 10

Pattern = tuple[int, ...]


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Every length, largest first, into the fullest sequences that have room for it. Sequences of equal content are one entry, so the work follows the number of lengths and not that of documents."""
    rooms: list[int] = []  # ascending, those in use
    open_: dict[int, list[list]] = defaultdict(list)  # room: [pattern, times]
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if not room:
            done.append((pattern, times))
        elif times:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append([pattern, times])

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            k = bisect.bisect_left(rooms, x)
            if k == len(rooms):
                room, pattern, times = size, (), -(-n // (size // x))
            else:
                room = rooms[k]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del rooms[k]
            each = min(room // x, n)
            full, rest = min(times, n // each), n % each
            if full < times and pattern:
                put(room, pattern, times - full - (rest > 0))
            elif full < times:
                times = full + (rest > 0)
            put(room - each * x, pattern + (x,) * each, full)
            n -= full * each
            if full < times and rest:
                put(room - rest * x, pattern + (x,) * rest, 1)
                n -= rest
    for room in rooms:
        done += [(p, t) for p, t in open_[room]]
    return done


def _pair(lengths, powers, counts: dict[int, int], room: int) -> Pattern:
    """The two items in stock that fit in room together and whose powers sum to most, the larger first. lengths and powers are ascending arrays of those in stock."""
    import numpy as np

    n = int(np.searchsorted(lengths, room - lengths[0], "right")) if len(lengths) else 0
    if not n:
        return ()
    mate = np.searchsorted(lengths, room - lengths[:n], "right") - 1
    places = np.arange(n)
    mate = np.minimum(mate, places)  # each pair once
    mate[[k for k in np.flatnonzero(mate == places).tolist() if counts[int(lengths[k])] < 2]] -= 1
    worth = np.where(mate >= 0, powers[:n] + powers[mate], -1.0)
    k = n - 1 - int(worth[::-1].argmax())
    return (int(lengths[k]), int(lengths[mate[k]])) if worth[k] > 0 else ()


def _extended(f: Pattern, lengths: list[int], counts: dict[int, int], room: int) -> Pattern:
    """f and, largest first, what of the stock beside it still fits, until nothing does."""
    out, rest = list(f), room - sum(f)
    k = bisect.bisect_right(lengths, rest) - 1
    while k >= 0:
        x = lengths[k]
        n = min(rest // x, counts[x] - f.count(x))
        out += [x] * n
        rest -= n * x
        k = min(k, bisect.bisect_right(lengths, rest)) - 1
    return tuple(out)


def fillings(lengths: list[int], counts: dict[int, int], room: int, power: float = 1.0, most: int = FILLINGS, tries: int = TRIES) -> list[Pattern]:
    """Undominated fillings of `room` from lengths (ascending, those in stock), those of the greatest sum of powers first: the best single item, the best pair, and the best pairs beside each of the largest items and pairs of equal items, `tries` of them, each extended until nothing in stock fits. A filling is left out if each of its items fits in the place of another item of one that is kept."""
    import numpy as np

    k = bisect.bisect_right(lengths, room)
    if not k:
        return []
    head: list[int] = []
    if room > 3 * lengths[k - 1]:  # many small items: the largest in stock take all but the room of the last few
        most_of, stock = lengths[k - 1], dict(counts)
        for x in lengths[k - 1 :: -1]:
            n = min(stock[x], max(0, (room - 2 * most_of) // x))
            head += [x] * n
            room -= n * x
            stock[x] -= n
            if room <= 3 * most_of:
                break
        counts, lengths = stock, [x for x in lengths if stock[x]]
        k = bisect.bisect_right(lengths, room)
        if not k:
            return [tuple(head)]
    small = np.array(lengths[:k], np.int64)
    worth = small.astype(float) ** power
    found: set[Pattern] = {(lengths[k - 1],)}
    perfect = power == 1 and lengths[k - 1] == room

    def beside(own: Pattern) -> bool:
        """Adds the best pair beside items that are taken first; whether best fit can't do better."""
        rest = room - sum(own)
        if rest < lengths[0] or any(counts[x] < own.count(x) for x in own):
            return False
        for x in own:
            counts[x] -= 1
        gone = [bisect.bisect_left(lengths, x) for x in set(own) if not counts[x]]
        p = _pair(np.delete(small, gone), np.delete(worth, gone), counts, rest) if gone else _pair(small, worth, counts, rest)
        for x in own:
            counts[x] += 1
        if p:
            found.add((*own, *p))
        return power == 1 and rest == sum(p)

    perfect = perfect or beside(())
    for x in lengths[k - 1 :: -1][:tries]:
        perfect = perfect or beside((x,))
    third = bisect.bisect_right(lengths, room // 3)
    for x in lengths[third - 1 :: -1][:tries] if third else ():
        perfect = perfect or beside((x, x))
    out: list[Pattern] = []
    whole = {tuple(sorted(_extended(f, lengths, counts, room), reverse=True)) for f in found}
    for f in sorted(whole, key=lambda f: (-sum(x**power for x in f), len(f), [-x for x in f])):
        if not any(len(f) <= len(g) and all(x <= y for x, y in zip(f, g, strict=False)) for g in out):
            out.append(f)
    return [(*head, *f) for f in out[:most]]


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No packing has fewer sequences: items over half the size need one each, and what they can't take of the items of at least `a` needs more."""
    best = -(-sum(x * n for x, n in counts.items()) // size)
    for a in [0, *[x for x in counts if 2 * x <= size]]:
        alone = sum(n for x, n in counts.items() if x > size - a)
        half = [(x, n) for x, n in counts.items() if size - a >= x > size / 2]
        rest = sum(x * n for x, n in counts.items() if size / 2 >= x >= a) - sum((size - x) * n for x, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-rest // size)))
    return best


def _search(counts: dict[int, int], size: int, power: float, best: int, bound: int, nodes: int) -> list[tuple[Pattern, int]] | None:
    """Branch and bound over bin completions, depth first: a packing of fewer than `best` sequences, or None if `nodes` more choices after the first dive give none."""
    counts, lengths = dict(counts), sorted(counts)
    rest, used, spare, dived = sum(x * n for x, n in counts.items()), 0, nodes, False
    found, path, choices = None, [], []

    def take(pattern: Pattern, times: int) -> None:
        for x in set(pattern):
            counts[x] -= times * pattern.count(x)
            if not counts[x]:
                del lengths[bisect.bisect_left(lengths, x)]

    def back(pattern: Pattern, times: int) -> None:
        for x in set(pattern):
            if not counts[x]:
                bisect.insort(lengths, x)
            counts[x] += times * pattern.count(x)

    while True:
        open_ = True
        if not lengths:
            if used < best:
                best, found = used, list(path)
            open_, dived = False, True
            if best <= bound:
                return found
        elif used - (-rest // size) >= best:  # the waste so far rules out fewer sequences than the incumbent has
            open_, dived = False, True
        if open_:
            top = lengths[-1]
            counts[top] -= 1
            fs = fillings(lengths if counts[top] else lengths[:-1], counts, size - top, power, FILLINGS if dived else 2, TRIES if power == 1 else TRIES // 3) or [()]
            counts[top] += 1
            choices.append([(top, *f) for f in reversed(fs)])
        while choices and not choices[-1]:
            choices.pop()
            if path:
                pattern, times = path.pop()
                back(pattern, times)
                used -= times
                rest += times * sum(pattern)
        spare -= dived
        if not choices or spare < 0:
            return found
        if len(path) == len(choices):  # the choice made here before has failed
            pattern, times = path.pop()
            back(pattern, times)
            used -= times
            rest += times * sum(pattern)
        pattern = choices[-1].pop()
        times = min(counts[x] // pattern.count(x) for x in set(pattern))
        if len(set(pattern)) > 1 and times > 1 and size > sum(pattern):
            times = max(1, times // 2)  # an imperfect filling leaves stock for better ones
        take(pattern, times)
        path.append((pattern, times))
        used += times
        rest -= times * sum(pattern)


def pack_histogram(counts: dict[int, int], size: int = SIZE, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns (lengths, times) that use up counts {length: number}, lengths from 1 to size: never more sequences than best fit decreasing has."""
    counts = {x: n for x, n in counts.items() if n}
    best, bound = best_fit_decreasing(counts, size), lower_bound(counts, size)
    for power in POWERS:
        n = sum(t for _, t in best)
        if n <= bound:
            break
        best = _search(counts, size, power, n, bound, nodes // len(POWERS)) or best
    return best


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, sorted: (first rank, first sequence, how many of the length a sequence has, first offset). The rank r of a document of that length is in the last entry that begins at or before it."""
    out, used, sequence = defaultdict(list), defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for x in dict.fromkeys(pattern):
            n = pattern.count(x)
            out[x].append((used[x], sequence, n, offset))
            used[x] += n * times
            offset += n * x
        sequence += times
    return dict(out)


def pieces(documents: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = 0, cache: int = CACHE) -> DataFrame:
    """Tokenizes: (doc_id, piece, start, length, ids_crc32, ids). A document longer than size is cut so that all pieces but the first are full."""
    import pyarrow as pa

    vocabulary = vocabulary or default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        import zlib

        enc, end = encoder(vocabulary, cache), int(end_id).to_bytes(4, "little")
        for b in batches:
            cols = [[], [], [], [], []]
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % size + 1
                    for piece, at in enumerate([0, *range(first, n, size)]):
                        stop = first if not piece else at + size
                        for c, x in zip(cols, (doc, piece, at, stop - at, zlib.crc32(memoryview(ids)[4 * at : 4 * stop])), strict=True):
                            c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def assign(items: DataFrame, size: int = SIZE, nodes: int = NODES, part_rows: int | None = None) -> DataFrame:
    """items: length (1 to size) and other columns, all of them a key to order ties by. Adds sequence_id and offset. Items of one length are numbered in parts of about part_rows, as many as their count asks for, so a length that a third of all items have isn't one task's work."""
    import pyarrow as pa

    spark = items.sparkSession
    names = items.columns
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    part_rows = part_rows or max(LEAST_ROWS, min(PART_ROWS, sum(counts.values()) // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    split = {x: -(-n // part_rows) for x, n in counts.items() if n > part_rows}
    parts = F.lit(1)
    for p in sorted(set(split.values())):
        parts = F.when(F.col("length").isin(sorted(x for x in split if split[x] == p)), p).otherwise(parts)
    keyed = items.withColumn("__salt", F.pmod(F.xxhash64(*names), parts).cast("int"))
    firsts = dict.fromkeys(((x, 0) for x in counts), 0)
    if split:
        at: dict[int, int] = defaultdict(int)
        for r in sorted(keyed.filter(F.col("length").isin(sorted(split))).groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a part
            firsts[r.length, r["__salt"]] = at[r.length]
            at[r.length] += r.n
    plan = spark.sparkContext.broadcast((firsts, places(pack_histogram(counts, size, nodes))))
    order = Window.partitionBy("length", "__salt").orderBy(*[F.col(c).asc_nulls_first() for c in names if c != "length"])
    ranked = keyed.withColumn("__rank", F.row_number().over(order).cast("long") - 1)
    at = [ranked.columns.index(c) for c in ("length", "__salt", "__rank")]

    def run(batches):
        firsts, spots = plan.value
        starts = {x: [s[0] for s in v] for x, v in spots.items()}
        for b in batches:
            seq, off = [], []
            for x, salt, r in zip(*[b.column(i).to_pylist() for i in at], strict=True):
                r += firsts[x, salt]
                first, sequence, n, offset = spots[x][bisect.bisect_right(starts[x], r) - 1]
                q, k = divmod(r - first, n)
                seq.append(sequence + q)
                off.append(offset + k * x)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack(documents: DataFrame, size: int = SIZE, vocabulary: str | None = None, end_id: int = 0, nodes: int = NODES, cache: int = CACHE) -> DataFrame:
    """Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    documents needs doc_id (integer, null allowed) and text; a null or empty text is the end id alone. Rows that repeat a doc_id are packed one by one. An empty table gives an empty table; extra columns are left alone. `nodes` bounds the search; the incumbent, at first that of best fit decreasing, is the result if it is used up. `cache` bounds a worker's memory for words that it has encoded (Encoder).
    """
    return assign(stage(pieces(documents, size, vocabulary, end_id, cache), "pieces"), size, nodes)


def op10_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
