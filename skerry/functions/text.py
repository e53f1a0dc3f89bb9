"""Column functions over text: terms, variants, queries and their intents."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Every letter that is another letter with marks, and that letter."""
    marked, bare = [], []
    for code in range(0xC0, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isalpha() and all(unicodedata.combining(m) for m in marks):
            marked.append(chr(code))
            bare.append(base)
    return "".join(marked), "".join(bare)


#: Letters with marks, which the full-text tokenizer folds, and what they become.
ACCENTS = _accents()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What a query must hold to count as one of an intent.
CONFIG_NEEDLES = (".toml", ".yaml", ".yml", ".json", "mount_point", "allow_roots", "deny_globs", "trust_label", "metrics_bind", "health_bind")
COMMAND_NEEDLES = ("run-step", "ap.add_argument(", "invoke-expression", "powershell", "executionpolicy", " -file ", ".ps1", ".sh", "bash -lc", "git ls-files", "cargo run")
WORKFLOW_NEEDLES = ("runs-on:", "uses:", "workflow_dispatch", "pull_request:", "actions/", "ubuntu-latest")
UNIT_NEEDLES = ("[unit]", "[service]", "[install]", "description=", "after=", "execstart=", "wantedby=", "restartsec=", "type=simple", ".service")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def query_terms(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


def overlap_terms(c: Column) -> Column:
    return F.filter(query_terms(c), lambda t: F.length(t) >= 3)


def embedding_tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(c, UPPER, LOWER), r"[^\p{L}\p{N}_]+"), "")


def search_terms(c: Column) -> Column:
    """Full-text terms: folded, lower-cased, split at what is neither letter nor digit. ASCII, the common case, skips the folding."""
    folded = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, *ACCENTS))
    return F.array_remove(F.split(F.lower(folded), r"[^\p{L}\p{N}]+"), "")


def pascal(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))), "")


def symbol_variants(c: Column) -> Column:
    """Spellings of a symbol query, in order, each once."""
    q = trimmed(c)
    spaced = F.regexp_replace(q, r"\s+", " ")
    terms = query_terms(q)
    snake = F.array_join(terms, "_")
    made = F.array(q, spaced, F.replace(spaced, F.lit(" "), F.lit("_")), snake, F.concat(F.lit("_"), snake), F.array_join(terms, ""), pascal(terms), F.regexp_replace(q, "^_+", ""))
    return F.filter(F.array_distinct(made), lambda v: (v != "") & (v != "_"))


def lower_distinct(c: Column) -> Column:
    """The strings of an array, A-Z lower-cased, each once, in order."""
    return F.array_distinct(F.transform(c, lambda v: F.translate(v, UPPER, LOWER)))


def bm25_variants(c: Column) -> Column:
    """Spellings of a full-text query, in the order in which they are tried: as it is, with blanks for underscores, its terms alone; each once but for case."""
    q = trimmed(c)
    made = F.array(q, trimmed(F.replace(q, F.lit("_"), F.lit(" "))), F.array_join(query_terms(q), " "))
    low = F.transform(made, lambda v: F.translate(v, UPPER, LOWER))
    first = F.transform(made, lambda v, i: F.when((v != "") & (F.array_position(low, F.get(low, i)) == i + 1), v))
    return F.array_compact(first)


def term_sets(c: Column) -> Column:
    """The distinct sets of terms that a query's spellings ask for, in order: spellings of the same terms have the same hits."""
    sets = F.transform(bm25_variants(c), lambda v: F.array_sort(F.array_distinct(search_terms(v))))
    return F.array_distinct(F.filter(sets, lambda s: F.size(s) > 0))


def normalize_spaces(c: Column) -> Column:
    """A suite's query: trimmed, white space as one blank, lower-cased."""
    return F.lower(F.regexp_replace(trimmed(c), r"\s+", " "))


def slug(c: Column) -> Column:
    """A label as a file name: lower-cased, runs of other characters than letters and digits as one underscore, none at the ends; "dataset" for what leaves nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "dataset").otherwise(s)


def cache_key(query: Column, snapshot: Column, active: Column) -> Column:
    return F.concat_ws("|", query, snapshot.cast("string"), active.cast("string"))


def hit_paths(markdown: Column) -> Column:
    """The paths of rendered hits: of each heading of level two what stands between its first two backticks, if that isn't blank."""
    heads = F.filter(F.split(markdown, "\r?\n"), lambda x: x.startswith("## "))
    found = F.transform(heads, lambda x: trimmed(F.regexp_extract(x, "^[^`]*`([^`]*)`", 1)))
    return F.filter(found, lambda p: p != "")


def fnv1a64(c: Column) -> Column:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, as a signed number.

    Numbers of 64 bits don't wrap in ANSI mode, so the hash is carried as two halves of 32 bits, whose products with the prime 2^40 + 435 stay below 2^63.
    """
    low, mask = 0x1B3, F.lit(0xFFFFFFFF)
    octets = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(c), F.lit(1))), lambda i: F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    octets = F.when(F.octet_length(c) > 0, octets).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, b: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(b)
        product = lo * low
        hi = acc["hi"] * low + F.shiftleft(lo, 8) + F.shiftright(product, 32)
        return F.struct(hi.bitwiseAND(mask).alias("hi"), product.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(octets, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


def normalize_query(c: Column) -> Column:
    """A query from a virtual file name."""
    return trimmed(F.replace(F.replace(F.regexp_replace(c, r"(\.md)+$", ""), F.lit("_"), F.lit(" ")), F.lit("%20"), F.lit(" ")))


def count_of(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def any_needle(c: Column, needles: tuple[str, ...]) -> Column:
    low = F.lower(trimmed(c))
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(low, F.lit(n))
    return out


def intents(q: Column) -> dict[str, Column]:
    """The eight facts about a query that limits, gates and priors depend on."""
    t = trimmed(q)
    config = any_needle(q, CONFIG_NEEDLES) | (F.contains(t, F.lit("=")) & (count_of(t, "=[]{}\"'") >= 2))
    symbol = t.rlike(r"^[A-Za-z0-9_:-]+$") & t.rlike("[_A-Z]")
    command, workflow, unit = any_needle(q, COMMAND_NEEDLES), any_needle(q, WORKFLOW_NEEDLES), any_needle(q, UNIT_NEEDLES)
    letters = F.length(q) - F.length(F.regexp_replace(q, "[A-Za-z]", ""))
    narrative = ~config & ~command & (F.size(query_terms(q)) >= 5) & (letters >= 20) & (count_of(q, "=[]{}\"'`") <= 2)
    schema = narrative & (count_of(q, "_") >= 3)
    return {"is_config": config, "is_symbol": symbol, "is_command": command, "is_workflow": workflow, "is_unit": unit, "is_narrative": narrative, "is_schema": schema, "is_literal": config | command | workflow | unit}


def bm25_limit(n: int = 20) -> Column:
    """From the columns of intents()."""
    c = F.col
    return F.when(c("is_workflow") | c("is_unit"), min(n, 6)).when(c("is_config") | c("is_command"), min(n, 8)).when(c("is_schema"), min(n, 10)).when(c("is_narrative"), min(n, 8)).otherwise(n)


def vector_limit(overlap: Column, symbol_hits: Column, bm25_hits: Column, docs_hint: Column, n: int = 20) -> Column:
    """Null: no vector search."""
    c = F.col
    closed = c("is_literal") | (c("is_symbol") & symbol_hits)
    hint, hits = c("is_narrative") & docs_hint, c("is_narrative") & bm25_hits
    return (
        F.when(closed, F.lit(None).cast("int"))
        .when(hint & c("is_schema"), min(n, 8))
        .when(hint & (overlap >= 7), F.lit(None).cast("int"))
        .when(hint, min(n, 6))
        .when(hits & c("is_schema"), min(n, 8))
        .when(hits & (overlap <= 4), min(n, 6))
        .when(hits, min(n, 8))
        .otherwise(n)
    )
