"""Domains and policies: decisions with reasons, ownership, budgets, schedules, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import climbs, hidden, matches_any, normalise

# Secret patterns.
SECRETS = (
    r"""(?i)api[_-]?key\s*[:=]\s*["']?[a-z0-9_\-]{12,}""",
    r"""(?i)secret\s*[:=]\s*["']?[a-z0-9_\-]{12,}""",
    r"""(?i)token\s*[:=]\s*["']?[a-z0-9_\-]{12,}""",
    r"-----BEGIN (RSA|EC|OPENSSH) PRIVATE KEY-----",
    r"ghp_[A-Za-z0-9]{20,}",
)
MIN_TOKEN_BYTES, MIN_ENTROPY = 20, 4.2


def decide(path: Column, allow: list[str], deny: list[str], allow_hidden: bool = False) -> tuple[Column, Column]:
    """(allowed, reason): denied globs, hidden segments, then allowed globs; with an allow list what it lacks is denied."""
    denied, secret, listed = matches_any(path, deny), hidden(path), matches_any(path, allow)
    allowed = ~denied & (F.lit(allow_hidden) | ~secret) & (listed if allow else F.lit(True)) & ~climbs(path)
    reason = F.when(climbs(path), "traversal").when(denied, "deny_glob").when(secret & ~F.lit(allow_hidden), "hidden").when(listed, "allow_glob").otherwise("deny_by_default" if allow else "no_allow_list")
    return allowed, reason


def can_reach(directory: Column, allow: list[str]) -> Column:
    """Whether an allowed pattern may match something below a directory: its fixed first segments agree with it."""
    out = F.lit(not allow)
    for g in allow:
        fixed = []
        for s in g.split("/")[:-1]:
            if any(c in s for c in "*?{["):
                break
            fixed.append(s)
        head = "/".join(fixed)
        open_ended = g.split("/")[len(fixed)] in ("**",) or not fixed
        out = out | (F.lit(head).startswith(directory) if head else F.lit(True)) | ((directory.startswith(head + "/") | (directory == head)) & F.lit(open_ended or "*" in g))
    return out


def traverse(path: Column, allow: list[str], deny: list[str]) -> Column:
    return ~matches_any(path, deny) & ~hidden(path) & (matches_any(path, allow) | can_reach(path, allow))


def domains(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> DataFrame:
    """(domain_id, root, trust_label, budget)."""
    return spark.createDataFrame(rows, "domain_id string, root string, trust_label string, budget int")


def depth(root: Column) -> Column:
    return F.size(F.array_remove(F.split(root, "/"), ""))


def schedule(plan: DataFrame) -> DataFrame:
    """schedule_rank: trusted before others, deeper roots first, then root and id. A plan has as many rows as the configuration has domains."""
    order = Window.orderBy(F.when(F.col("trust_label") == "trusted", 0).otherwise(1), F.desc("depth"), "root", "domain_id")
    return plan.withColumn("depth", depth(F.col("root"))).withColumn("schedule_rank", F.row_number().over(order))


def violations(plan: DataFrame) -> DataFrame:
    """(domain_id, root, error) of what breaks the contract."""
    checks = (("empty_id", F.trim("domain_id") == ""), ("empty_root", F.trim("root") == ""), ("unknown_trust", ~F.col("trust_label").isin("trusted", "untrusted")), ("traversal_root", climbs(F.col("root"))), ("negative_budget", F.col("budget") < 0))
    each = plan.select("domain_id", "root", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))).alias("error"))
    twice = lambda c, e: plan.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(plan, c).select("domain_id", "root", F.lit(e).alias("error"))
    return each.unionByName(twice("domain_id", "duplicate_id")).unionByName(twice("root", "duplicate_root"))


def resolve_owner(files: DataFrame, plan: DataFrame) -> DataFrame:
    """The first domain in schedule order whose root holds a path; a file meets each domain of the configuration once."""
    ranked = F.broadcast(schedule(plan).select(F.col("domain_id").alias("owner"), "root", F.col("trust_label").alias("owner_trust"), "schedule_rank"))
    hit = files.join(ranked, (F.col("path") == F.col("root")) | F.col("path").startswith(F.concat("root", F.lit("/"))))
    return hit.groupBy("path").agg(F.min_by(F.struct("owner", "root", "owner_trust", "schedule_rank"), "schedule_rank").alias("o")).select("path", "o.*")


def overlap_pairs(plan: DataFrame) -> DataFrame:
    """Pairs of domains whose roots are equal or hold one another; a configuration is small."""
    s = schedule(plan)
    a = s.select(F.col("domain_id").alias("a_id"), F.col("root").alias("a_root"), F.col("schedule_rank").alias("a_rank"))
    b = s.select(F.col("domain_id").alias("b_id"), F.col("root").alias("b_root"), F.col("schedule_rank").alias("b_rank"))
    inside = lambda x, y: F.col(x).startswith(F.concat(y, F.lit("/")))
    return a.join(F.broadcast(b), (F.col("a_rank") < F.col("b_rank")) & ((F.col("a_root") == F.col("b_root")) | inside("a_root", "b_root") | inside("b_root", "a_root"))).select("a_id", "b_id")


def prune_targets(targets: DataFrame) -> DataFrame:
    """Of (path, recursive, priority) what no other recursive target covers; equal paths merge to the recursive and highest."""
    merged = targets.groupBy("path").agg(F.max("recursive").alias("recursive"), F.max("priority").alias("priority"))
    parts = F.split("path", "/")
    above = merged.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up")).filter("up <> path")
    covered = above.join(merged.filter("recursive").select(F.col("path").alias("up")), "up").select("path").distinct()
    return merged.join(covered, "path", "left_anti")


Target = tuple[str, bool, int]


def prune_ordered(targets: list[Target], most: int = 0) -> list[Target]:
    """Of a configuration's targets (path, recursive, priority) what is left in order: higher priority first, those not recursive before others, deeper ones first, then by path; what an earlier recursive one covers is dropped, one of an earlier one's path is merged with it; the first `most`, or all."""
    out: list[Target] = []
    for path, recursive, priority in sorted(targets, key=lambda t: (-t[2], t[1], -len([x for x in t[0].split("/") if x]), t[0])):
        if any(r and (path == p or path.startswith(p + "/")) for p, r, _ in out):
            continue
        same = [k for k, t in enumerate(out) if t[0] == path]
        if same:
            p, r, n = out[same[0]]
            out[same[0]] = (p, r or recursive, max(n, priority))
            continue
        out.append((path, recursive, priority))
        if most and len(out) >= most:
            break
    return out


def _fixed(parts: list[str]) -> list[str]:
    """The segments before the first with a wildcard."""
    for k, x in enumerate(parts):
        if any(c in x for c in "*?[{"):
            return parts[:k]
    return parts


def fan_out(root: str, children: dict[str, bool], priority: int) -> list[Target]:
    """A root's children, {name: is a directory}, as targets, by lower-cased name."""
    return prune_ordered([(f"{root}/{c}", children[c], priority) for c in sorted(children, key=lambda c: (c.lower(), c))])


def scan_targets(patterns: list[str], root: str, priority: int, directories: set[str] = frozenset(), children: dict[str, bool] | None = None) -> list[Target]:
    """What must be scanned for a domain's allowed patterns: a directory before a final "**", or before "/**/", with all below it; that before a wildcard in the last segment alone; a path without wildcards itself, with all below it if it is one of `directories`. Without patterns, or for one that is none of these, it is the whole root; for one that takes everything the root's children, if they are given. A configuration's work."""
    out: list[Target] = []
    for pattern in patterns:
        parts = [x for x in pattern.replace("\\", "/").strip("/").split("/") if x]
        fixed = _fixed(parts)
        at, rest = "/".join([root, *fixed]), parts[len(fixed) :]
        if not fixed and rest in (["**"], ["**", "*"]):
            if children:
                return fan_out(root, children, priority)
            out.append((root, True, priority))
        elif not rest:
            out.append((at, "/".join(fixed) in directories, priority))
        elif fixed and rest[0] == "**":
            out.append((at, True, priority))
        elif len(rest) == 1 and rest[0] != "**":
            out.append((at, False, priority))
        else:
            return [(root, True, priority)]
    return prune_ordered(out) if patterns else [(root, True, priority)]


def effective(plan: DataFrame, allow: list[str], deny: list[str], trusts: list[str]) -> DataFrame:
    """plan (domain_id, root, trust_label, allow, deny: arrays of patterns): allowed patterns are the domain's own, or the general ones where it has none; denied ones are the general ones and its own, each once. priority_class: the trust label and its tier."""
    general = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    inherits = F.coalesce(F.size("allow") == 0, F.lit(True))
    tier = F.array_position(general(trusts), F.col("trust_label"))
    kind = F.when(tier > 0, F.concat("trust_label", F.lit(":tier_"), tier.cast("string"))).otherwise(F.concat("trust_label", F.lit(":invalid_trust")))
    return plan.select("domain_id", "root", "trust_label", F.when(inherits, general(allow)).otherwise(F.col("allow")).alias("allow"), F.array_distinct(F.concat(general(deny), F.coalesce("deny", general([])))).alias("deny"), inherits.alias("inherits_allow"), kind.alias("priority_class"))


def pattern_violations(plan: DataFrame) -> DataFrame:
    """(domain_id, field, pattern, error) of patterns of effective() that are empty, absolute or climb, and of fields without patterns."""
    each = plan.select("domain_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("patterns")) for f in ("allow", "deny")])))
    none = each.filter(F.size("patterns") == 0).select("domain_id", "field", F.lit(None).cast("string").alias("pattern"), F.lit("no_patterns").alias("error"))
    one = each.select("domain_id", "field", F.explode("patterns").alias("pattern"))
    absolute = F.col("pattern").rlike(r"^\s*([/\\]|[A-Za-z]:)")
    wrong = F.when(F.trim("pattern") == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(F.when(absolute, F.lit("absolute")), F.when(climbs(F.col("pattern")), F.lit("traversal")))))
    return none.unionByName(one.select("domain_id", "field", "pattern", F.explode(wrong).alias("error")))


def fits(size_bytes: Column, max_mib: int) -> Column:
    """Whole mebibytes count."""
    return F.shiftright(size_bytes, 20) <= max_mib


def domain_budget(files: DataFrame, budget: int, max_mib: int = 10) -> DataFrame:
    """parse_status of each file: per domain the first `budget` files of allowed size in schedule order (path) are indexed; after that the others are capped, before it those too large are so marked."""
    fits_ = fits(F.col("size_bytes"), max_mib)
    w = Window.partitionBy("domain_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(fits_.cast("int")).over(w), F.lit(0))
    return files.select("domain_id", "path", F.when(before >= budget, "domain_budget_capped").when(~fits_, "too_large").otherwise("indexed").alias("parse_status"))


def secret_scan(files: DataFrame) -> DataFrame:
    return files.filter(F.col("content").rlike("|".join(f"(?:{p})" for p in SECRETS))).select("path")


def contains_secret(files: DataFrame) -> DataFrame:
    """(path) of files that match a secret's pattern or hold a token of high entropy."""
    return secret_scan(files).unionByName(entropy_tokens(files).select("path")).distinct()


def redact(hits: DataFrame, allow: list[str], deny: list[str], allow_hidden: bool = False) -> DataFrame:
    """Hits whose path the policy allows; ranks stay as they were."""
    return hits.filter(decide(F.col("path"), allow, deny, allow_hidden)[0])


def virtual_path(domain_id: Column, relative: Column, multi_root: bool) -> Column:
    """A file's name to readers: below its domain's identifier if there are several roots, else its path in the one root."""
    if not multi_root:
        return relative
    return F.when(relative == "", domain_id).otherwise(F.concat_ws("/", domain_id, relative))


def resolve_virtual(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """paths (path, virtual names of several roots): (path, domain_id, relative, disk_path, trust_label) of those that begin with a domain's identifier, don't climb, and are owned by that very domain, not by one whose root lies deeper."""
    p = normalise(F.col("path"))
    named = paths.select("path", F.substring_index(p, "/", 1).alias("domain_id"), F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "^[^/]*/", "")).otherwise("").alias("relative"))
    found = named.filter(~climbs(F.col("relative"))).join(plan.select("domain_id", "root", "trust_label"), "domain_id")
    found = found.withColumn("disk_path", F.when(F.col("relative") == "", F.col("root")).otherwise(F.concat_ws("/", "root", "relative")))
    owners = resolve_owner(found.select(F.col("disk_path").alias("path")).distinct(), plan).select(F.col("path").alias("disk_path"), "owner")
    return found.join(owners, "disk_path").filter("owner = domain_id").select("path", "domain_id", "relative", "disk_path", "trust_label")


def entropy_tokens(files: DataFrame, text: str = "content", least: float = MIN_ENTROPY) -> DataFrame:
    """(path, token, entropy) of tokens of at least MIN_TOKEN_BYTES bytes whose Shannon entropy, with character counts over the byte length, exceeds `least`. Distinct tokens are judged once."""
    tokens = files.select("path", F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("token")).filter(F.octet_length("token") >= MIN_TOKEN_BYTES)
    chars = tokens.select("token").distinct().select("token", F.explode(F.split("token", "")).alias("ch")).filter("ch <> ''").groupBy("token", "ch").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.octet_length("token")
    judged = chars.groupBy("token").agg(F.round(F.sum(-p * F.log2(p)), 6).alias("entropy")).filter(F.col("entropy") > least)
    return tokens.join(judged, "token").select("path", "token", "entropy")


def trust(label: Column) -> tuple[Column, Column]:
    """Trust level as ranking sees it (all but "untrusted" is trusted) and as the guard does (only "trusted" is)."""
    return F.when(F.lower(label) == "untrusted", "untrusted").otherwise("trusted"), F.when(F.lower(label) == "trusted", "trusted").otherwise("untrusted")
