"""Design-level extensions: operations that are only described, not implemented, where the others come from.

Their semantics are fixed here and labelled as our own: evaluation metrics, intelligence gates, typed scope targets,
document chunks and entities, windows over alerts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.functions.names import host_name
from vigilake.functions.text import checked
from vigilake.operators import scan


def confusion(labelled: DataFrame) -> DataFrame:
    """Counts of (expected, predicted) booleans."""
    return labelled.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def metrics(labelled: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and false-alarm share over booleans expected and predicted; null where nothing is counted."""
    e, p = F.col("expected"), F.col("predicted")
    c = labelled.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(fp, fp + tn).alias("false_alarms"))


def text_features(text: Column) -> dict[str, Column]:
    """What the junk score looks at, each cut into steps: the share of letters and spaces, the mean length of words, and the share of words that came before."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(t, r"[^a-zA-Z ]", ""))
    step = lambda a, b, size: F.coalesce(F.floor(F.try_divide(a * size, b)), F.lit(-1)).cast("int")
    return {"letters": step(letters, F.length(t), 20), "word_length": F.least(F.coalesce(F.floor(F.try_divide(F.length(F.array_join(words, "")), F.size(words))), F.lit(-1)), F.lit(15)).cast("int"), "new_words": step(F.size(F.array_distinct(words)), F.size(words), 20)}


def fitted(labelled: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """A naive Bayes score from rows (expected, and features in steps): (feature, step, weight), the logarithm of how much likelier a step is where something is expected; add-one smoothed.

    The row of feature `` has the logarithm of the odds. A row for each step that was seen, so a small table at any size.
    """
    each = F.explode(F.array(F.struct(F.lit("").alias("feature"), F.lit(0).alias("step")), *(F.struct(F.lit(c).alias("feature"), F.col(c).alias("step")) for c in features)))
    yes, no = F.count_if("expected"), F.count_if(~F.col("expected"))
    steps = labelled.select("expected", each.alias("x")).groupBy("x.feature", "x.step").agg(yes.alias("yes"), no.alias("no"))
    totals = labelled.agg(yes.alias("all_yes"), no.alias("all_no"))
    both = steps.crossJoin(F.broadcast(totals))  # one row
    seen = F.log((F.col("yes") + 1) / (F.col("no") + 1))
    return both.select("feature", "step", F.round(F.when(F.col("feature") == "", seen).otherwise(seen - F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1))), 6).alias("weight"))


def scored(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """rows (features in steps) with score and predicted: the sum of the weights of their steps is above zero; steps that were never seen add nothing."""
    by = {(r.feature, r.step): r.weight for r in weights.collect()}  # some dozens of rows
    value = F.lit(by.get(("", 0), 0.0))
    for feature in sorted({f for f, _ in by if f}):
        pairs = [F.lit(x) for (f, step), w in sorted(by.items()) if f == feature for x in (step, w)]
        value = value + F.coalesce(F.element_at(F.create_map(*pairs), F.col(feature)), F.lit(0.0))
    return rows.withColumn("score", F.round(value, 6)).withColumn("predicted", F.col("score") > 0)


def fresh(candidates: DataFrame, as_of: str) -> DataFrame:
    """Knowledge candidates (retrieved_on date, ttl_days) with expired."""
    return candidates.withColumn("expired", F.date_add("retrieved_on", F.col("ttl_days")) < F.lit(as_of).cast("date"))


def source_gate(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Items of registered, enabled sources; those of low trust are never promoted automatically. Unknown sources are blocked."""
    joined = items.join(checked(registry), "source_id", "left")
    verdict = F.when(~F.coalesce("enabled", F.lit(False)), "blocked").when(F.coalesce("trust_level", F.lit("low")) == "low", "review").otherwise("auto")
    return joined.withColumn("gate", verdict)


def ipv4(x: Column) -> Column:
    """An address as a number; null if it is none."""
    parts = F.transform(F.split(x, r"\."), lambda p: F.try_to_number(p, F.lit("999")).cast("long"))
    ok = F.regexp_like(x, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")) & F.forall(parts, lambda p: p <= 255)
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def in_cidr(x: Column, cidr: Column) -> Column:
    size = F.pow(F.lit(2.0), 32 - F.split_part(cidr, F.lit("/"), F.lit(2)).cast("int")).cast("long")
    return F.floor(ipv4(x) / size) == F.floor(ipv4(F.split_part(cidr, F.lit("/"), F.lit(1))) / size)


def typed_match(target: Column, kind: Column, value: Column, apex: Column) -> Column:
    """Whether a rule of a kind (host, domain, url_prefix, ip, cidr) fits a target; names without case and final dot."""
    name = lambda x: F.regexp_replace(F.lower(x), r"\.$", "")
    t, v = name(target), name(value)
    return F.coalesce(
        F.when(kind == "host", t == v).when(kind == "domain", F.endswith(t, F.concat(F.lit("."), v)) | (apex & (t == v))).when(kind == "url_prefix", F.startswith(target, value)).when(kind == "ip", ipv4(target) == ipv4(value)).when(kind == "cidr", in_cidr(target, value)),
        F.lit(False),
    )


def _let(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def ipv6(x: Column) -> Column:
    """An address as its eight groups of four small hex digits, joined by colons; null if it is none. It may end with an IPv4 address and stand in brackets."""
    half = lambda part: F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def groups(low: Column) -> Column:
        left, right = half(F.split_part(low, F.lit("::"), F.lit(1))), half(F.split_part(low, F.lit("::"), F.lit(2)))
        gap = F.when(F.contains(low, F.lit("::")), F.greatest(8 - F.size(left) - F.size(right), F.lit(1))).otherwise(0)
        return F.concat(left, F.array_repeat(F.lit("0"), gap), right)

    def without_dots(low: Column) -> Column:
        tail = lambda v4: F.when(v4.isNull(), low).otherwise(F.concat(F.regexp_replace(low, r"[^:]*$", ""), F.lower(F.hex(F.floor(v4 / 65536))), F.lit(":"), F.lower(F.hex(v4 % 65536))))
        return F.when(F.contains(low, F.lit(".")), _let(ipv4(F.substring_index(low, ":", -1)), tail)).otherwise(low)

    def joined(low: Column) -> Column:
        ok = F.regexp_like(low, F.lit(r"^[0-9a-f:]*:[0-9a-f:]*$")) & ~F.regexp_like(low, F.lit("::.*::"))
        fits = lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda p: F.length(p).between(1, 4)), F.array_join(F.transform(g, lambda p: F.lpad(p, 4, "0")), ":"))
        return F.when(ok, _let(groups(low), fits))

    return _let(F.regexp_replace(F.lower(x), r"^\[(.*)\]$", "$1"), lambda low: _let(without_dots(low), joined))


def _address(x: Column) -> Column:
    """One spelling for each address, of either kind; null if it is none."""
    return F.coalesce(ipv4(x).cast("string"), ipv6(x))


def _bits6(x: Column) -> tuple[Column, Column]:
    """The two halves of an IPv6 address (its digits, see `_digits6`) as longs."""
    return tuple(F.conv(F.substr(x, F.lit(at), F.lit(16)), 16, -10).cast("long") for at in (1, 17))


def _digits6(x: Column) -> Column:
    return F.replace(ipv6(x), F.lit(":"), F.lit(""))


def _net6(high: Column, low: Column, size: Column) -> Column:
    """The network of so many bits that an address is in, as a key."""
    ones = lambda n: F.when(n >= 64, F.lit(-1).cast("long")).when(n > 0, F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - n).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.concat(F.lower(F.hex(high.bitwiseAND(ones(size)))), F.lit("/"), F.lower(F.hex(low.bitwiseAND(ones(size - 64)))), F.lit("/"), size.cast("string"))


def networks(nets: DataFrame) -> DataFrame:
    """nets (net, ...) with key: a network of either kind of address, written with a prefix length or as a single address; null if it is none. Bits beyond the prefix do not count."""
    value, given = F.split_part("net", F.lit("/"), F.lit(1)), F.contains("net", F.lit("/"))
    size = F.when(given, F.try_to_number(F.split_part("net", F.lit("/"), F.lit(2)), F.lit("999")).cast("int"))
    n4, n6 = F.coalesce(size, F.when(~given, 32)), F.coalesce(size, F.when(~given, 128))
    return nets.withColumn("key", F.coalesce(F.when(n4.between(0, 32), _net(ipv4(value), n4)), F.when(n6.between(0, 128), _let(_digits6(value), lambda d: _net6(*_bits6(d), n6)))))


def longest_prefix(targets: DataFrame, nets: DataFrame) -> DataFrame:
    """targets (target, ...) with net, the smallest of nets (net) that holds the address, of either kind, and bits, its length; null if there is none.

    A target is looked up once for each length that occurs among the networks (161 at most), by an equi-join; of networks that
    are the same, the first in order of their text is given.
    """
    known = networks(nets.select("net").distinct()).where("key is not null").groupBy("key").agg(F.min("net").alias("net"))
    size = F.substring_index("key", "/", -1).cast("int")
    six = F.size(F.split("key", "/")) == 3
    lengths = {bool(r.six): sorted(r.sizes) for r in known.groupBy(six.alias("six")).agg(F.collect_set(size).alias("sizes")).collect()}  # two rows
    sizes = lambda kind: F.array(*(F.lit(n) for n in lengths.get(kind, []))).cast("array<int>")
    ip, (high, low) = F.col("__ip"), _bits6(F.col("__six"))
    keys = F.when(ip.isNotNull(), F.transform(sizes(False), lambda n: _net(ip, n))).when(high.isNotNull(), F.transform(sizes(True), lambda n: _net6(high, low, n)))
    tried = targets.select("target").where("target is not null").distinct().withColumns({"__ip": ipv4(F.col("target")), "__six": _digits6(F.col("target"))}).select("target", F.explode(keys).alias("key"))
    best = tried.join(checked(known), "key").groupBy("target").agg(F.max_by(F.struct("net", size.alias("bits")), size).alias("b"))
    return targets.join(best.select(F.col("target").alias("__t"), "b.net", "b.bits"), F.col("target") == F.col("__t"), "left").drop("__t")


def _target_keys(target: Column, name: Column, six: Column, tags: Column, longest: Column, lengths: list[int]) -> Column:
    """All keys (kind, key) under which a rule for the target may stand; longest: of the url prefixes that rules have; lengths: of their IPv6 networks."""
    labels, ip, (high, low) = F.split(name, r"\."), ipv4(target), _bits6(six)
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    one = lambda kind, k: F.array(key(kind, k))
    suffix = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    above = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: key("domain", suffix(i))))
    nets = F.when(ip.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(32)), lambda n: key("cidr", _net(ip, n))))
    nets6 = [F.when(high.isNotNull(), F.transform(F.array(*map(F.lit, lengths)), lambda n: key("cidr", _net6(high, low, n))))] if lengths else []
    prefixes = F.when(longest > 0, F.transform(F.sequence(F.lit(1), F.least(F.length(target), longest)), lambda n: key("url_prefix", F.left(target, n))))
    parts = [one("host", name), one("apex", name), one("ip", _address(target)), above, nets, *nets6, prefixes, F.transform(tags, lambda t: key("tag", F.lower(t)))]
    return F.flatten(F.array_compact(F.array(*parts)))


def _net(ip: Column, size: Column) -> Column:
    return F.concat(F.floor(ip / F.pow(F.lit(2.0), 32 - size).cast("long")).cast("string"), F.lit("/"), size.cast("string"))


def _rule_keys(rules: DataFrame) -> DataFrame:
    """rules as (layer, rank, kind, key); a domain that includes its apex stands under two keys. Rules of unknown layers or kinds fit nothing."""
    kind, value = F.col("kind"), F.col("value")
    key = F.when(kind.isin("host", "domain"), host_name(value)).when(kind == "url_prefix", value).when(kind == "ip", _address(value)).when(kind == "cidr", F.col("__net")).when(kind == "tag", F.lower(value))
    kinds = F.when((kind == "domain") & F.coalesce("include_apex", F.lit(False)), F.array(F.lit("domain"), F.lit("apex"))).otherwise(F.array(kind))
    rules = networks(rules.withColumn("net", F.when(kind == "cidr", value))).withColumnRenamed("key", "__net")
    ranked = rules.select("layer", F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")).alias("rank"), F.explode(kinds).alias("kind"), key.alias("key"))
    return ranked.where("rank > 0 and key is not null")


#: Who wins: the first of these with a rule that fits; none means deny.
LAYERS = ("platform_deny", "tenant_deny", "scope_deny", "scope_allow")


def scope_verdict(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """targets (target, and tags array<string> if they have any) with the layer that decides and allow or deny; rules: layer, kind, value, include_apex.

    Kinds: host, domain (names below it), url_prefix, ip and cidr (either version) and tag; names are compared without case and final dot,
    international ones in their ASCII form (see `names.host_name`). Every target is looked up under all the keys that could fit it (as
    `typed_match` says, and beyond it for IPv6 and international names), so that rules are found by an equi-join, however many there are.
    """
    tags = F.col("tags") if "tags" in targets.columns else F.array().cast("array<string>")
    keyed = _rule_keys(rules)
    longest = F.lit(keyed.where("kind = 'url_prefix'").agg(F.max(F.length("key"))).first()[0] or 0)
    six = keyed.where("kind = 'cidr'").select(F.split("key", "/").alias("k")).where("size(k) = 3")
    lengths = sorted(int(r[0]) for r in six.select(F.col("k")[2]).distinct().collect())  # 129 at most
    own = ["target", *(["tags"] if "tags" in targets.columns else [])]
    wanted = targets.select(own).where("target is not null").distinct().withColumns({"__name": host_name(F.col("target")), "__six": _digits6(F.col("target"))})
    tried = wanted.select(*own, F.explode(_target_keys(F.col("target"), F.col("__name"), F.col("__six"), F.coalesce(tags, F.array().cast("array<string>")), longest, lengths)).alias("k")).select(*own, "k.kind", "k.key").where("key is not null")
    best = keyed.groupBy("kind", "key").agg(F.min("rank").alias("rank"))
    hit = tried.join(checked(best), ["kind", "key"]).groupBy(own).agg(F.min("rank").alias("rank"))
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), F.col("rank").cast("int"))
    hit = hit.withColumnsRenamed({c: f"__{c}" for c in own})
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own]
    out = targets.join(hit, on, "left").select(*targets.columns, F.when(F.col("rank").isNotNull(), layer).alias("layer"))
    return out.withColumn("verdict", F.when(F.col("layer") == "scope_allow", "allow").otherwise("deny"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """Documents by content hash: how many, and the first of them."""
    return docs.groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


def chunks(docs: DataFrame, size: int, step: int) -> DataFrame:
    """Overlapping pieces of size characters, one every step."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    return docs.select("doc_id", F.explode(starts).alias("start"), "text").select("doc_id", "start", F.substr("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


# fixed values: patterns of entities
ENTITIES = {"cve": r"CVE-\d{4}-\d{4,7}", "ipv4": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "hash": r"\b[0-9a-f]{40}\b"}


def _named(kind: str):
    return lambda m: F.struct(F.lit(kind).alias("entity_type"), m.alias("value"))


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, entity_type, value, n) of the entities named in texts."""
    each = F.concat(*(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _named(k)) for k, p in ENTITIES.items()))
    return docs.select("doc_id", F.explode(each).alias("e")).groupBy("doc_id", "e.entity_type", "e.value").agg(F.count("*").alias("n"))


def conflicts(claims: DataFrame) -> DataFrame:
    """Entities (entity, attribute, value, source) on which sources disagree."""
    return claims.groupBy("entity", "attribute").agg(F.countDistinct("value").alias("values"), F.countDistinct("source").alias("sources")).where(F.col("values") > 1)


def windowed_counts(alerts: DataFrame, width: str) -> DataFrame:
    """Alerts (ts, key) per key and tumbling window; works on a stream as well."""
    return alerts.groupBy(F.window("ts", width).alias("w"), "key").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def suppressed(alerts: DataFrame, rules: DataFrame, at: str) -> DataFrame:
    """alerts with suppressed: a complete, unexpired rule names their dedup key; no alert is dropped."""
    whole = rules.where("reason is not null and evidence is not null and scope is not null and owner is not null").where(F.col("expiry") > at).select("dedup_key").distinct()
    return alerts.join(checked(whole.withColumn("__s", F.lit(True))), "dedup_key", "left").withColumn("suppressed", F.coalesce("__s", F.lit(False))).drop("__s")


def priority(disposition: Column, confidence: Column) -> Column:
    """P0 to P3 from disposition and confidence."""
    return F.when((disposition == "escalate") & (confidence >= 0.8), "P0").when(disposition == "escalate", "P1").when(disposition == "monitor", "P2").otherwise("P3")


def missing_headers(responses: DataFrame, required: list[str]) -> DataFrame:
    """One row per required header that a response (asset_id, headers) lacks."""
    lacking = F.array_except(F.array(*map(F.lit, required)), F.coalesce("headers", F.array().cast("array<string>")))
    return responses.select("asset_id", F.explode(lacking).alias("header"))


#: What an approval is bound to: any change of these makes it void.
BINDING = ("plan_id", "scope_id", "scope_version", "policy_hash")


def approvals_valid(plans: DataFrame, approvals: DataFrame, at: str) -> DataFrame:
    """plans (the columns of BINDING) with approved: an unexpired approval for exactly that plan, version of the scope, and policy."""
    good = approvals.where(F.col("decision") == "approved").where(F.col("expires_at") > at).select(*BINDING).distinct().withColumn("__a", F.lit(True))
    return plans.join(good, list(BINDING), "left").withColumn("approved", F.coalesce("__a", F.lit(False))).drop("__a")


def scope_errors(scopes: DataFrame) -> DataFrame:
    """Scopes (targets, owner, valid_from, valid_until, max_rate) with the names of the rules that they break, in order."""
    checks = (
        ("no_targets", F.coalesce(F.size("targets"), F.lit(0)) <= 0), ("any_target", F.exists("targets", lambda t: t.isin("*", "0.0.0.0/0"))), ("no_owner", F.coalesce("owner", F.lit("")) == ""),
        ("no_end", F.col("valid_until").isNull()), ("window_reversed", F.col("valid_until") <= F.col("valid_from")), ("no_rate_limit", F.coalesce("max_rate", F.lit(0)) <= 0),
    )
    return scopes.withColumn("errors", F.array_compact(F.array(*(F.when(broken, name) for name, broken in checks))))


# fixed values: phrases that try to instruct a reader of the text
INJECTIONS = ("ignore previous instructions", "disregard the above", "you are now", "system prompt")
TAG = r"<[a-zA-Z/][^>]*>"
MAX_INTAKE_CHARS = 20_000


def screened(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with what keeps them from intake: too_large, markup, injection, address, secret (one of high severity), and accepted; stripped is the text without its tags."""
    low = F.lower("text")
    injection = F.lit(False)
    for phrase in INJECTIONS:
        injection = injection | F.contains(low, F.lit(phrase))
    flags = {"too_large": F.length("text") > MAX_INTAKE_CHARS, "markup": F.regexp_like("text", F.lit(TAG)), "injection": injection, "address": F.regexp_like("text", F.lit(ENTITIES["ipv4"])), "secret": scan.has_secret(F.col("text"))}
    out = docs.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return out.withColumn("accepted", ~(F.col("too_large") | F.col("markup") | F.col("injection") | F.col("address") | F.col("secret")) & F.col("text").isNotNull()).withColumn("stripped", F.regexp_replace("text", TAG, " "))


def enriched(findings: DataFrame, exploited: DataFrame, likelihood: DataFrame) -> DataFrame:
    """Findings (cve) with known_exploited and likelihood (null if unknown), from two sources keyed by cve, one row each."""
    known = exploited.select("cve").distinct().withColumn("__k", F.lit(True))
    return findings.join(known, "cve", "left").join(likelihood, "cve", "left").withColumn("known_exploited", F.coalesce("__k", F.lit(False))).drop("__k")


# fixed values: the places at which an action is judged again
BOUNDARIES = ("plan", "queue", "dispatch", "start", "before_request", "after_response", "finish")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key's highest version."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("__r")).select(key, "__r.*")


def at_boundaries(requests: DataFrame) -> DataFrame:
    """Each request once for every boundary; policy.decide then judges all of them by the scope that holds now."""
    return requests.withColumn("boundary", F.explode(F.array(*map(F.lit, BOUNDARIES))))


def remembered(entries: DataFrame, as_of: str) -> DataFrame:
    """The latest version of each memory entry (key, version, written_on, ttl_days, value) that has not outlived its time."""
    return latest(entries, "key", "version").where(F.date_add("written_on", F.col("ttl_days")) >= F.lit(as_of).cast("date"))


def handoffs(edges: DataFrame, most: int) -> DataFrame:
    """For each task (task, parent; parent null for a first one) how many handoffs led to it, `most` looked at.

    state: ok, too_deep (the chain goes on) or cycle (the task comes up among those before it). A join for each step of the limit.
    """
    at = edges.select("task", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.lit(False).alias("cycle"))
    step = edges.select(F.col("task").alias("up"), F.col("parent").alias("next"), F.lit(True).alias("found"))
    for _ in range(most):
        go = F.col("up").isNotNull() & ~F.col("cycle")
        at = at.join(step, "up", "left").select("task", F.when(go, F.col("next")).otherwise(F.col("up")).alias("up"), (F.col("depth") + go.cast("int")).alias("depth"), (F.col("cycle") | (go & (F.col("up") == F.col("task")))).alias("cycle"))
    return at.select("task", "depth", F.when(F.col("cycle"), "cycle").when(F.col("up").isNotNull(), "too_deep").otherwise("ok").alias("state"))
