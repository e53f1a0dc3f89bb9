"""The ten operators against brute force, round trips and held-out accuracy, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from skerry.llm import decontaminate, gif, langid, linededup, packing, pii, sharding, simhash, sstable, warc
from skerry.llm.common import new_path

SF = "/root/testdata/sf0.001"
rnd = random.Random(7)
VOCAB = ["alpha", "Beta", "gämma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Lambda", "mu", "nü", "xi", "omicron"]


def sentence(n, r=rnd):
    return " ".join(r.choice(VOCAB) + r.choice(["", "", ",", ".", "-"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    base = [sentence(r.randint(1, 120), r) for _ in range(40)]
    lines = ["  This line is long enough to be counted by the operator. \t", "This Line is long enough to be counted by the operator."]
    out = [None, "", " ", "\n\n", "x", "A", "ß É", "word " * 5000, "9" * 3000]
    out += base + base[:5] + [b + " extra" for b in base[20:30]] + [b + "\n" + lines[k % 2] for k, b in enumerate(base[:12])] + [f"{lines[0]}\n{lines[1]}\n{b}" for b in base[12:16]]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in texts], "doc_id long, text string, n_lines string, shard int")


EMPTY = "doc_id long, text string, lang string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_warc_round_trip(spark):
    pages = [(1, "http://a.b/c?d=1", "<p>x"), (2, None, "<p>x"), (3, "http://a/é b", None), (4, "q", ""), (5, "q", "WARC/1.1\r\n\r\n\r\n"), (7, "u", "<p>x"), (7, "u", "<p>x"), (8, "u", "z" * 200_000), (None, "u", "nobody")]
    df = spark.createDataFrame([(*p, "w") for p in pages], "page_id long, url string, html string, payload string")
    path = new_path(spark, "test-warc")
    warc.write_archives(df, path)
    got = warc.assemble(warc.read_records(spark, path)).collect()
    owner = {}
    for i, _, h in pages:
        owner[h or ""] = max(owner.get(h or "", -1), -1 if i is None else i)
    seen = Counter()
    for r in got:
        page = re.search(r"page-id: (\d*)", r.metadata[0].fields)[1]
        assert r.requests[0].concurrent_to == r.metadata[0].concurrent_to == [r.capture.record_id]
        seen[page, r.capture.record_type, r.capture.payload_digest] += 1
        if r.capture.record_type == "response":
            assert hashlib.sha1(r.capture.payload).digest() == base64.b32decode(r.capture.payload_digest)
    want = Counter()
    for i, _, h in pages:
        kind = "response" if (-1 if i is None else i) == owner[h or ""] else "revisit"
        want["" if i is None else str(i), kind, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()] += 1
    assert seen == want
    assert {r.capture.refers_to.split(":")[2] for r in got if r.capture.record_type == "revisit"} == {"7", "4"}


def records(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "record_type string, record_id string, concurrent_to array<string>")
    for c in warc.RECORDS.split(", ")[3:]:
        df = df.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    return df


def test_warc_orphans_and_empty(spark):
    rows = [("request", "r1", ["gone"]), ("metadata", "m1", ["gone"]), ("response", "a", []), ("warcinfo", "w", [])]
    got = {r.capture_id: r for r in warc.assemble(records(spark, rows)).collect()}
    assert got["gone"].capture is None and got["gone"].n_requests == 1 and got["a"].requests == [] and len(got) == 2
    path = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


def test_warc_links_in_both_directions_and_over_steps(spark):
    rows = [
        ("request", "q1", []), ("response", "p1", ["q1", "m1"]), ("metadata", "m1", None),  # the response names the others
        ("request", "q2", ["p2"]), ("response", "p2", []), ("metadata", "m2", ["q2"]), ("metadata", "n2", ["m2", "q2"]),  # metadata of the request
        ("request", "q3", ["x", "p3"]), ("response", "p3", []), ("conversion", "c3", ["p3"]),  # the first value names nothing that is there
        ("response", "p4", ["p5"]), ("revisit", "p5", []), ("request", "q4", ["p4"]), ("request", "q4", ["p4"]),
        ("response", "p6", []), ("response", "p6", []),
        ("response", None, None), ("request", None, None),
    ]
    got = defaultdict(list)
    for r in warc.assemble(records(spark, rows)).collect():
        got[r.capture and r.capture.record_id].append((sorted(x.record_id for x in r.requests), sorted(x.record_id for x in r.metadata), [x.record_id for x in r.others], r.n_requests))
    assert got["p1"] == [(["q1"], ["m1"], [], 1)]
    assert got["p2"] == [(["q2"], ["m2", "n2"], [], 1)]
    assert got["p3"] == [(["q3"], [], ["c3"], 1)]
    assert got["p4"] == got["p5"] == [(["q4"], [], [], 2)]
    assert got["p6"] == [([], [], [], 0)] * 2
    assert got[""] == [([""], [], [], 1)] and None not in got


def test_warc_members_repeated_headers_and_broken():
    import gzip

    head = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nX: one\r\n two\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    bodies = [b"", b"x" * 5, b"\r\n\r\n", random.Random(1).randbytes(300_000), b"last"]
    parts = [head % (len(x), x) for x in bodies]
    for data in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts)), gzip.compress(parts[0] + parts[1][:90]) + gzip.compress(parts[1][90:]) + gzip.compress(b"".join(parts[2:])) + gzip.compress(b"")):
        got = [(h, bytes(b)) for h, b in warc.parse(data)]
        assert [b for _, b in got] == bodies
        assert all(h["warc-concurrent-to"] == ["<a>", "<b>"] and h["x"] == ["one two"] for h, _ in got)
        for cut in (len(data) - 9, len(data) // 2):
            with pytest.raises(ValueError):
                list(warc.parse(data[:cut]))


def test_warc_files_are_bounded_and_members_are_records(spark):
    import zlib

    r = random.Random(8)
    pages = spark.createDataFrame([(k, "http://a/", r.randbytes(3000).hex()) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "test-warc")
    warc.write_archives(pages, path, file_bytes=40_000)
    files = [bytes(f.content) for f in spark.read.format("binaryFile").load(path).collect() if f.length]
    assert len(files) > 3 and max(map(len, files)) < 50_000
    n = 0
    for data in files:
        while data:
            d = zlib.decompressobj(31)
            one = d.decompress(data)
            assert d.eof and len(list(warc.parse(one))) == 1
            n, data = n + 1, d.unused_data
    assert n == 180


def test_decontaminate(spark, texts, docs):
    r = random.Random(2)
    long = words(texts[20][1])
    items = [(1, " ".join(long[3:25])), (2, "Nothing of this kind " * 4), (3, "ß"), (4, None), (5, "--"), (10, " ".join(long[3:25])), (11, "alpha beta"), (12, sentence(30, r))]
    bench = spark.createDataFrame([(*i, "b") for i in items], "item_id long, text string, ws string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        ws, hit, ids = words(t), set(), set()
        for i, x in items:
            iw = words(x)
            g = min(10, len(iw))
            for k in range(len(iw) - g + 1 if g else 0):
                for p in range(len(ws) - g + 1):
                    if ws[p : p + g] == iw[k : k + g]:
                        hit |= set(range(p, p + g))
                        ids.add(str(i))
        g = got[d]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (len(ws), len(hit), len(ids), bool(hit)), t
        assert g.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert any(g.contaminated for g in got.values())
    assert decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0
    assert decontaminate.contamination(spark.createDataFrame([], EMPTY), bench).count() == 0


def test_decontaminate_across_blocks_and_repeats(spark):
    ws = [f"w{k}" for k in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(ws)), (1, " ".join(ws)), (None, " ".join(ws[2000:2300])), (2, "w1 w2")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(ws[2040:2060])), (2, " ".join(ws[4090:4101])), (None, " ".join(ws[10:20]))], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [("1", 41, 2), ("1", 41, 2), ("2", 0, 0), ("None", 20, 1)]


def test_line_dedup(spark, texts, docs):
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    strip = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for d, t in texts:
        for s in (t or "").split("\n"):
            if len(strip(s)) >= 40:
                held[strip(s)].add(d)
    often = {k: max(v) for k, v in held.items() if len(v) >= 5}
    assert often
    for d, t in texts:
        kept = [s for s in (t or "").split("\n") if often.get(strip(s), d) == d]
        assert got[d].n_lines == len((t or "").split("\n")) and got[d].n_dropped == got[d].n_lines - len(kept)
        assert (got[d].text or "") == "\n".join(kept)
    assert linededup.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0


def test_line_runs_levels(spark):
    store = linededup.LineRuns(spark, settled=3, fanout=2)
    rows = [[1, 1, 1, 2], [1, 2, 5], [2, 7], [7, 7]]
    for b in rows:
        store.add(spark.createDataFrame([(k,) for k in b], "k1 long"))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    assert {r.k1 for r in store.frequent().collect()} == {1, 2, 7}


def test_gif(spark, texts, docs):
    for r in gif.store_as_gif(docs).collect():
        raw = (texts[r.doc_id][1] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    frames = gif.decode_frames(gif.store_as_gif(docs).limit(3)).collect()
    assert all(sum(f.histogram[:8]) == f.width * f.height for f in frames)
    for data in (b"", b"a" * 9000, random.Random(3).randbytes(90_000), bytes(range(256)) * 40):
        assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def test_gif_disposal_transparency_and_broken(spark):
    def frame(left, top, w, h, samples, disposal, delay, key, interlace=False):
        packed = disposal << 2 | (key is not None)
        return b"\x21\xf9\x04" + bytes([packed]) + delay.to_bytes(2, "little") + bytes([key or 0, 0]) + b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x40 * interlace]) + b"\x02" + gif._sub_blocks(gif.lzw_encode(samples, 2)) + b"\x3b"[:0]

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + b"\x04\0\x04\0" + b"\x81\0\0" + palette
    data = head + frame(0, 0, 4, 4, bytes([1] * 16), 1, 5, None) + frame(1, 1, 2, 2, bytes([2, 0, 2, 0]), 2, 7, 0) + frame(0, 0, 1, 1, b"\3", 3, 1, None) + frame(3, 3, 2, 2, bytes([2] * 4), 0, 1, None, True) + b"\x3b"
    w, h, frames = gif.parse_gif(data)
    seen = [c.copy() for c in gif.composite(w, h, frames)]
    assert seen[0][:, :, 0].sum() == 255 * 16
    assert seen[1][1, 1].tolist() == [0, 255, 0, 255] and seen[1][1, 2].tolist() == [255, 0, 0, 255]
    assert seen[2][1, 1].tolist() == [0, 0, 0, 0] and seen[2][0, 0].tolist() == [0, 0, 255, 255]
    assert seen[3][0, 0].tolist() == [255, 0, 0, 255] and seen[3][3, 3].tolist() == [0, 255, 0, 255]
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data[:40])), ("c", None), ("d", bytearray(b""))], "doc_id string, media binary")
    got = gif.decode_frames(df).orderBy("frame").collect()
    assert [(r.doc_id, r.start_ms, r.delay_ms) for r in got] == [("a", 0, 50), ("a", 50, 70), ("a", 120, 10), ("a", 130, 10)]


def test_lzw_deferred_clear():
    data = random.Random(5).randbytes(9000)
    table, codes, code = {}, [256], data[0]
    for c in data[1:]:
        if (code, c) in table:
            code = table[code, c]
            continue
        codes.append(code)
        if len(table) + 258 < 4096:
            table[code, c] = len(table) + 258
        code = c
    codes += [code, 257]
    acc = have = 0
    width, size = 9, 257
    for k, c in enumerate(codes):
        acc |= c << have
        have += width
        size = min(4096, size + (k > 0))
        width = min(12, max(9, size.bit_length()))
    assert gif.lzw_decode(acc.to_bytes(-(-have // 8), "little"), 8) == data


def test_sharding(spark, docs):
    df = docs.unionByName(docs.filter("doc_id < 9"))
    got = sharding.shuffle_into_shards(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == df.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in df.collect())
    again = sharding.shuffle_into_shards(df.repartition(7)).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.shard, r.slot) for r in got)
    assert sharding.shuffle_into_shards(spark.createDataFrame([], EMPTY)).count() == 0


def test_communication_matrix_is_exact_and_fair():
    rows = [5, 0, 17, 1000, 3]
    m = sharding.communication_matrix(rows, 8, 1)
    assert [sum(line) for line in m] == rows and sorted({sum(c) for c in zip(*m, strict=True)}) == [128, 129]
    first = sum(sharding.communication_matrix([50, 50], 2, s)[0][0] for s in range(2000)) / 2000
    assert abs(first - 25) < 0.5


def ids_of(texts):
    from tokenizers import Tokenizer

    from skerry.llm.tokens import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


ODD = ["a  b\n\nc", " lead", "trail \n", "x<|endoftext|>y z", "tab\tx y", "don't we'll 'sun", "a\x00b c", "nb\xa0sp ace", "é　q", "\r\nx", "a \n b", "1 000 000,5", "naïve—dash … end", " a b"]


def test_tokens_equal_the_library():
    from skerry.llm.tokens import Encoder, default_vocabulary

    texts = ODD + [sentence(50) + "\n" + sentence(20) for _ in range(50)]
    got = Encoder(default_vocabulary()).encode(texts)
    assert [list(memoryview(g).cast("I")) for g in got] == [i[:-1] for i in ids_of(texts)]


def test_sstable(spark, texts):
    rows = [(d * 3 - 20, t) for d, t in texts] + [(5000 + k, t) for k, t in enumerate(ODD)] + [(None, "nobody"), (4, "again"), (4, "again")]
    df = spark.createDataFrame([(*r, "i") for r in rows], "doc_id long, text string, ids string")
    path = new_path(spark, "test-sst")
    sstable.write_tables(df, path, file_bytes=2000)
    got = sorted(sstable.read_tables(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for g, w, ids in zip(got, want, ids_of([t for _, t in want]), strict=True):
        assert (g.doc_id, g.start, g.n_tokens, list(memoryview(g.ids).cast("I"))) == (w[0], at, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        at += len(ids)
    found = {r.doc_id: list(memoryview(r.ids).cast("I")) for r in sstable.lookup(spark, path, [5003, 1, 999999, -20]).collect()}
    assert found == {5003: ids_of([ODD[3]])[0], 1: ids_of([texts[7][1]])[0], -20: [0]}
    path = new_path(spark, "test-sst")
    sstable.write_tables(spark.createDataFrame([], EMPTY), path)
    assert sstable.read_tables(spark, path).count() == 0


def test_sstable_filter_and_index():
    w = sstable.Writer()
    for k in range(0, 4000, 2):
        w.add(sstable.key_of(k), b"v%d" % k, 1)
    t = sstable.Table(w.finish())
    assert len(t.blocks) > 3 and all(t.get(sstable.key_of(k)) == (1, b"v%d" % k) for k in range(0, 4000, 2))
    assert all(t.get(sstable.key_of(k)) is None for k in range(1, 4000, 2))
    assert sum(t.may_hold(sstable.key_of(k)) for k in range(1, 4000, 2)) < 100


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def naive(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) < 256 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii._luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_equals_plain_patterns():
    r = random.Random(9)
    for _ in range(3000):
        t = "".join(r.choice(["@", ".", "-", "+", "1", "22", "4111 1111 1111 1111", "300", "a", "B_", " ", "(", ")", "é", "x@y.z", "1.2.3.4", "\n"]) for _ in range(r.randint(0, 40)))
        assert pii.find(t) == naive(t), t


@pytest.mark.parametrize(
    ("text", "kind", "inner"),
    [
        ("write to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("mail bob at example dot org please", "email", "bob at example dot org"),
        ("ann(at)mail.example.net", "email", "ann(at)mail.example.net"),
        ("pаul@exаmple.com", "email", "pаul@exаmple.com"),
        ("user＠example．com", "email", "user＠example．com"),
        ("x j​o@example.com", "email", "j​o@example.com"),
        ("call plus four one five five five five two six seven one!", "phone", "plus four one five five five five two six seven one"),
        ("host ten 192 dot 168 dot one dot seven", "ip", "192 dot 168 dot one dot seven"),
        ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ],
)
def test_pii_deobfuscates(text, kind, inner):
    _, added = pii.scan(text)
    at = text.index(inner)
    assert (kind, at, at + len(inner)) in added


@pytest.mark.parametrize("text", ["we met at noon and at dot one", "look at that. Com is", "at the dot com era", "one two three", "the list: five, six, seven, eight", "meet @ home", "Привет мир", ""])
def test_pii_leaves_clean_text_alone(text):
    assert pii.scan(text) == ([], [])


def test_pii_rows(spark, docs):
    df = spark.createDataFrame([(1, "a@b.c 1.2.3.4", "s"), (1, "a@b.c 1.2.3.4", "s"), (None, None, None), (3, "j at b dot com", "s")], "doc_id long, text string, spans string")
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_added, r.spans) for r in pii.detect(df).collect())
    assert got == [("1", 1, 1, 0, "email:0:5,ip:6:13")] * 2 + [("3", 0, 0, 1, "email:0:14"), ("None", 0, 0, 0, "")]
    assert pii.detect(spark.createDataFrame([], EMPTY)).count() == 0


def fingerprint(t):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("cap", [1024, 1])
def test_simhash(spark, texts, docs, cap):
    r = random.Random(4)
    more = [(d, t) for d, t in texts]
    base = sentence(300, r)
    for k in range(25):
        ws = base.split(" ")
        for _ in range(k % 4):
            ws[r.randrange(len(ws))] = "changed"
        more.append((1000 + k, " ".join(ws)))
    fps = {d: fingerprint(t) for d, t in more}
    want = components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    df = spark.createDataFrame([(*m, 3) for m in more], "doc_id long, text string, fp int")
    got = {x.doc_id: x for x in simhash.near_duplicates(df, cap=cap).collect()}
    assert {d: x.fp & (1 << 64) - 1 for d, x in got.items()} == fps
    assert {d: x.component_id for d, x in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_simhash_links_are_complete(spark):
    r = random.Random(6)
    fps = set()
    for _ in range(30):
        c = r.getrandbits(64)
        for _ in range(12):
            x = c
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    mask = (1 << 64) - 1
    want = components(sorted(fps), lambda a, b: ((a ^ b) & mask).bit_count() <= 4)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for cap in (1024, 2):
        edges = [(e.u, e.v) for e in simhash.links(df, cap=cap).collect()]
        assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in edges)
        linked = set(edges) | {(b, a) for a, b in edges}
        assert components(sorted(fps), lambda a, b, linked=linked: (a, b) in linked) == want
    for n in (10, 10**4, 10**7, 10**10, 10**14):
        segs = simhash.segments(n, 4)
        assert sum(q + 1 for _, _, q in segs) + 0 >= 5 and all(w > 0 for _, w, _ in segs)  # pigeonhole: r + 1 differing bits can't avoid all balls


def test_simhash_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "entirely other words here now")], "doc_id long, text string")
    got = sorted((str(x.doc_id), str(x.component_id)) for x in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def test_langid_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_langid_edges(spark):
    rows = [(1, "bonjour tout le monde", "fr"), (2, "hello all the world", "en"), (3, None, "en"), (4, "12 34", None), (5, "", "en"), (None, "le monde", None), (6, "hello " * 20000, "en"), (8, "hello again world", "en"), (9, "le petit monde", "fr")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(df)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {3, 4, 5} and all(got[d].rejected and got[d].score == 0 for d in (3, 4, 5))
    assert got[None].lang_pred == "fr"
    empty = spark.createDataFrame([], EMPTY)
    assert langid.fit(empty) is None and langid.identify(df, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_optimal_on_small_cases(seed):
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(9)]

    def best(items, free, n):
        if not items:
            return True
        tried = set()
        for k in range(len(free)):
            if free[k] >= items[0] and free[k] not in tried:
                tried.add(free[k])
                free[k] -= items[0]
                if best(items[1:], free, n):
                    return True
                free[k] += items[0]
        return False

    n = next(n for n in range(1, 10) if best(sorted(items, reverse=True), [20] * n, n))
    got = packing.pack_histogram(dict(Counter(items)), 20)
    assert sum(t for _, t in got) == n
    assert Counter(x for p, t in got for x in p * t) == Counter(items) and all(sum(p) <= 20 for p, _ in got)


def test_packing_near_the_bound():
    r = random.Random(1)
    counts = Counter(min(2048, max(1, int(r.lognormvariate(6.3, 0.9)))) for _ in range(20000))
    got = packing.pack_histogram(dict(counts))
    assert sum(t for _, t in got) <= 1.002 * packing.lower_bound(counts, 2048)
    used = Counter()
    for p, t in got:
        for x in p:
            used[x] += t
    assert used == counts


def check_packed(rows, ids, size):
    of, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for d, parts in of.items():
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            own = ids[d][at : at + r.length]
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
            assert k == 0 or r.length == size
            at += r.length
        assert at == len(ids[d])
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= size


def test_packing(spark, texts):
    df = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, length int")
    rows = packing.pack(df).collect()
    check_packed(rows, dict(zip([d for d, _ in texts], ids_of([t for _, t in texts]), strict=True)), 2048)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, None)], "doc_id long, text string")
    assert len({(r.sequence_id, r.offset) for r in packing.pack(twice).collect()}) == 4
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0
