"""Secret scans through a trigram inverted index, in DataFrame and SQL functions only.

From each rule's regular expression a Boolean trigram query is derived: the strings that every match must hold become
conjunctions of their lower-cased trigrams, alternatives become disjunctions. One pass over the texts emits the trigrams that
some query asks for; these postings (trigram, text) are written sorted by trigram. Each conjunction is intersected from its
rarest trigram: only texts in that list are looked up in the others. Texts that satisfy a query are candidates of its rule,
and only candidates are verified with the regular expression. Rules without a mandatory trigram, and expressions that the
reader doesn't know for sure, scan every text.

Spans are in code points, ends exclusive. They come from the pieces between matches: the start of a match is the length of
all pieces and matches before it, so no position is searched twice.

Defined results: a null text counts as empty; an empty text or table has no spans; a very long text is scanned whole; rows are
scanned one by one, so repeated rows give repeated results; a null doc_id keeps its row; other columns, whatever their names,
are kept by ``scan`` and ``redact``.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser as reader

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import materialize, text_or_empty, unused


@dataclass(frozen=True)
class Rule:
    """kind, expression, and the group that must have at least ``least`` characters (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, without flags that fold beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")

#: The base kinds come first, in the order in which kinds are listed.
BASE = (
    Rule("assign", f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),  # maximal runs, so the same as dropping shorter matches
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Further kinds: fixed values, the public formats of keys and tokens.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("prefixed", "(ghp|gho|ghs|xoxb|xoxp|glpat|AIza)[_-][A-Za-z0-9_-]{16,}"),
    Rule("github_fine", "github_pat_[A-Za-z0-9_]{22,}"),
    Rule("github_user", "gh[ru]_[A-Za-z0-9]{36,}"),
    Rule("slack_app", "xapp-[0-9]-[A-Z0-9]+-[0-9]+-[a-z0-9]+"),
    Rule("slack_other", "xox[ares]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", "hooks\\.slack\\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("google_access", "ya29\\.[A-Za-z0-9_-]{20,}"),
    Rule("google_client", "[0-9]+-[0-9a-z]{32}\\.apps\\.googleusercontent\\.com"),
    Rule("aws_session", "ASIA[A-Z0-9]{16}"),
    Rule("aws_market", "amzn\\.mws\\.[0-9a-f-]{36}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    Rule("sendgrid", "SG\\.[A-Za-z0-9_-]{22}\\.[A-Za-z0-9_-]{43}"),
    Rule("mailgun", "key-[0-9a-f]{32}"),
    Rule("mailchimp", "[0-9a-f]{32}-us[0-9]{1,2}"),
    Rule("npm", "npm_[A-Za-z0-9]{36}"),
    Rule("pypi", "pypi-AgE[A-Za-z0-9_-]{50,}"),
    Rule("digitalocean", "do[opr]_v1_[0-9a-f]{64}"),
    Rule("heroku", "HRKU-[A-Za-z0-9_-]{36,}"),
    Rule("shopify", "shp(at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("square", "sq0(atp|csp)-[A-Za-z0-9_-]{22,}"),
    Rule("telegram", "[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("discord_hook", "discord(app)?\\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+"),
    Rule("azure_storage", "AccountKey=[A-Za-z0-9+/=]{60,}"),
    Rule("database_url", "(postgres|postgresql|mysql|mongodb|redis|amqp)://[^\\x20\\x09-\\x0D:@/]+:[^\\x20\\x09-\\x0D@/]+@[A-Za-z0-9.-]+"),
    Rule("web_login", "https?://[^\\x20\\x09-\\x0D:@/]+:[^\\x20\\x09-\\x0D@/]+@[A-Za-z0-9.-]+"),
    Rule("bearer", "[Bb]earer [A-Za-z0-9._~+/=-]{20,}"),
    Rule("hub_token", "hf_[A-Za-z0-9]{34}"),
    Rule("model_key", "sk-[A-Za-z0-9_-]{20,}"),
    Rule("vault", "hvs\\.[A-Za-z0-9_-]{24,}"),
    Rule("databricks", "dapi[0-9a-f]{32}"),
    Rule("grafana_cloud", "glc_[A-Za-z0-9+/=]{32,}"),
    Rule("grafana_service", "glsa_[A-Za-z0-9]{32}_[0-9a-fA-F]{8}"),
    Rule("linear", "lin_api_[A-Za-z0-9]{40}"),
    Rule("newrelic", "NRAK-[A-Z0-9]{27}"),
    Rule("planetscale", "pscale_(tkn|pw)_[A-Za-z0-9_.-]{32,}"),
    Rule("age", "AGE-SECRET-KEY-1[A-Z0-9]{58}"),
    Rule("putty", "PuTTY-User-Key-File-[23]"),
    Rule("doppler", "dp\\.pt\\.[A-Za-z0-9]{40,}"),
    Rule("postman", "PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    Rule("dynatrace", "dt0c01\\.[A-Z0-9]{24}\\.[A-Z0-9]{64}"),
    Rule("sentry", "sntrys_[A-Za-z0-9+/=_]{20,}"),
    Rule("notion", "ntn_[A-Za-z0-9]{40,}"),
    Rule("atlassian", "ATATT3[A-Za-z0-9_=-]{50,}"),
)

#: Strings kept of a part of an expression, characters told apart in a class, and conjunctions of a query.
STRINGS, MEMBERS, CONJUNCTIONS = 64, 4, 64
#: Flags that leave the meaning of literals alone, but for their case.
KNOWN_FLAGS = re.IGNORECASE | re.MULTILINE | re.DOTALL

Query = list[frozenset[str]]  # a disjunction of conjunctions; an empty conjunction is always true
ALWAYS: Query = [frozenset()]


def mandatory(pattern: str) -> list[list[str]]:
    """Disjunction of conjunctions of lower-cased trigrams that each match of ``pattern`` holds; [] if there are none.

    The expression is read by Python's reader. What it doesn't accept, warns of, or may mean otherwise in the engine that
    verifies (unknown escapes, set operations within classes, other flags) has no query.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            if "&&" in pattern:
                return []
            tree = reader.parse(pattern)
            if tree.state.flags & ~(KNOWN_FLAGS | re.UNICODE):
                return []
            query = _closed(*_read(tree))
    except (re.error, Warning, NotImplementedError, OverflowError, RecursionError):
        return []
    return sorted(sorted(c) for c in query) if all(query) else []


def _grams(strings: set[str]) -> Query:
    return _least([frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in strings])


def _least(query: Query) -> Query:
    """Without conjunctions that another one implies."""
    kept = set(query)
    return [c for c in kept if not any(d < c for d in kept)]


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > CONJUNCTIONS:  # either alone is still mandatory
        return min(a, b, key=lambda q: (not all(q), len(q)))
    return _least([x | y for x, y in product(a, b)])


def _closed(strings: set[str] | None, query: Query) -> Query:
    return query if strings is None else _both(query, _grams(strings))


def _read(tree: reader.SubPattern) -> tuple[set[str] | None, Query]:
    """All strings that the part can match, lower-cased, if they are few (else None), and a query that its matches satisfy."""
    grown: set[str] = {""}  # what may stand at the end of the part read so far, since it was last cut
    query, whole = ALWAYS, True
    for op, arg in tree:
        if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and 1 <= arg[0] < arg[1]:
            # The first repetition stands after what was read, the last before what follows; between them anything may be.
            strings, more = _read(arg[2])
            if strings is not None:
                more = _both(more, _grams({a + b for a, b in product(grown, strings)} if len(strings) * len(grown) <= STRINGS else strings))
            query, whole = _both(_both(query, _grams(grown)), more), False
            grown = {""} if strings is None else strings
            continue
        strings, more = _one(op, arg)
        query = _both(query, more)
        if strings is not None and len(strings) * len(grown) <= STRINGS:
            grown = {a + b for a, b in product(grown, strings)}
        else:
            query, whole = _both(query, _grams(grown)), False
            grown = {""} if strings is None else strings
    return (grown, query) if whole else (None, _both(query, _grams(grown)))


def _one(op: object, arg: object) -> tuple[set[str] | None, Query]:
    anything: tuple[set[str] | None, Query] = (None, ALWAYS)
    if op is K.LITERAL:
        return ({chr(arg).lower()}, ALWAYS) if arg < 128 else anything
    if op is K.IN:
        members = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                members.add(value)
            elif kind is K.RANGE and value[1] - value[0] < 2 * MEMBERS:
                members |= set(range(value[0], value[1] + 1))
            else:
                return anything
        chars = {chr(m).lower() for m in members if m < 128}
        return (chars, ALWAYS) if all(m < 128 for m in members) and len(chars) <= MEMBERS else anything
    if op in (K.ANY, K.NOT_LITERAL, K.GROUPREF):
        return anything
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):  # of no length
        return {""}, ALWAYS
    if op is K.SUBPATTERN:
        _, added, removed, inner = arg
        if (added | removed) & ~KNOWN_FLAGS:
            raise NotImplementedError("flags")
        return _read(inner)
    if op is K.ATOMIC_GROUP:
        return _read(arg)
    if op is K.BRANCH:
        parts = [_read(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= STRINGS:
            return set().union(*(s for s, _ in parts)), ALWAYS
        either = _least([c for part in parts for c in _closed(*part)])
        return None, either if len(either) <= CONJUNCTIONS else ALWAYS
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        low, high, inner = arg
        strings, query = _read(inner)
        if low == 0:
            return ({*strings, ""}, ALWAYS) if high == 1 and strings is not None and query == ALWAYS and len(strings) < STRINGS else anything
        if strings is None:
            return None, query
        repeated = {""}
        for _ in range(min(low, 3)):
            if len(repeated) * len(strings) > STRINGS:
                return None, _closed(strings, query)
            repeated = {a + b for a, b in product(repeated, strings)}
        return (repeated, query) if low == high <= 3 else (None, _closed(repeated, query))
    raise NotImplementedError(str(op))


#: Candidates, each a key of 16 bytes and a few rule numbers, that are sent to all tasks at most.
BROADCAST = 400_000
#: Letters from the most to the least frequent in running text, after the space; all else is rarer.
FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"


def looked_up(conjunction: list[str], most: int) -> list[str]:
    """The ``most`` trigrams of the rarest characters. Fewer trigrams make more candidates but lose none, and keep the index
    small: common ones would be posted for nearly every text."""
    rarity = lambda g: -sum(FREQUENT.index(c) if c in FREQUENT else 40 for c in g)
    return sorted(sorted(conjunction, key=lambda g: (rarity(g), g))[:most])


def spans_by(text: Column, pattern: Column, group: Column, least: Column, place: Column, kind: Column) -> Column:
    """array<struct<start, place, kind, end>> of the matches of ``pattern`` whose ``group`` has at least ``least`` characters."""
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, pattern, group), lambda x: F.length(x))
    empty = F.array().cast("array<struct<start:int,end:int,size:int>>")
    walked = F.aggregate(
        F.arrays_zip(pieces.alias("p"), matches.alias("m"), sizes.alias("g")),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + x["p"] + F.coalesce(x["m"], F.lit(0))).alias("at"),
            F.when(x["g"] >= least, F.array_append(acc["found"], F.struct((acc["at"] + x["p"]).alias("start"), (acc["at"] + x["p"] + x["m"]).alias("end"), x["g"].alias("size"))))
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    found = F.transform(walked, lambda s: F.struct(s["start"].alias("start"), place.alias("place"), kind.alias("kind"), s["end"].alias("end")))
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast(SPANS))


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """``spans_by`` of one rule."""
    return spans_by(text, *map(F.lit, (rule.pattern, rule.group, rule.least, place, rule.kind)))


def spans_of_some(text: Column, numbers: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans of the rules of these numbers, with one expression however many rules there are."""
    of = lambda name: F.array(*[F.lit(getattr(r, name)) for r in rules])
    return F.flatten(F.transform(numbers, lambda i: spans_by(text, *(F.get(of(n), i) for n in ("pattern", "group", "least")), i, F.get(of("kind"), i))))


SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key): the trigrams of each text of ``keyed`` (key, text) that are asked for, from one pass over it."""
    low = keyed.select("key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("key", F.explode(present).alias("gram")).select("gram", "key")


def candidates(index: DataFrame, asked: dict[int, list[list[str]]]) -> tuple[DataFrame, list[str]]:
    """(key, rules) of texts that satisfy the queries ``asked`` (by rule), and the rarest trigram of each conjunction.

    Only counts by trigram reach the driver, and only
    the queries are broadcast: both are as many as the rules ask for.
    """
    spark = index.sparkSession
    held = {r["gram"]: r["n"] for r in index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    conjunctions = [(rule, c, min(c, key=lambda g: (held.get(g, 0), g))) for rule, q in asked.items() for c in q]
    rare = sorted({g for _, _, g in conjunctions})
    query = F.broadcast(spark.createDataFrame([(k, rule, len(c), g) for k, (rule, c, _) in enumerate(conjunctions) for g in c], "conjunction int, rule int, n int, gram string"))
    near = index.where(F.col("gram").isin(rare)).select("key").distinct()
    met = index.join(near, "key", "left_semi").join(query, "gram").groupBy("key", "conjunction", "rule", "n").agg(F.collect_set("gram").alias("met")).where(F.size("met") == F.col("n"))
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules")), rare


def spans_column(docs: DataFrame) -> str:
    """What ``scan`` calls its column: spans, with underscores after it where docs has that."""
    return unused(docs, "spans")[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, most: int = 2) -> DataFrame:
    """docs with a column by ``spans_column`` (array of struct<start, place, kind, end>, ordered) for every row.

    The index is written once. Rows meet the candidates by a key of their text, so equal texts are candidates alike and rows
    need no id. Up to ``BROADCAST`` candidates go to the rows. If there are more, rows that hold no conjunction's rarest
    trigram can't be candidates and stay where they are; only the others are shuffled. ``most`` trigrams of a conjunction are
    looked up.
    """
    asked = {i: [looked_up(c, most) for c in q] for i, r in enumerate(rules) if (q := mandatory(r.pattern))}
    spans, (key, named) = spans_column(docs), unused(docs, "_key", "_rules")
    text = text_or_empty()
    none = F.array().cast(SPANS)
    rest = F.concat(none, *[spans_of(text, r, i) for i, r in enumerate(rules) if i not in asked])
    if not asked:
        return docs.withColumn(spans, F.array_sort(rest))
    hashes = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    grams = sorted({g for q in asked.values() for c in q for g in c})
    index, _ = materialize(postings(docs.select(hashes.alias("key"), text.alias("text")), grams).distinct().sortWithinPartitions("gram"), "trigrams")
    met, rare = candidates(index, asked)
    found, _ = materialize(met.select(F.col("key").alias(key), F.col("rules").alias(named)), "candidates")
    every = F.array_sort(F.when(F.col(named).isNull(), rest).otherwise(F.concat(rest, spans_of_some(text, F.col(named), rules))))
    if found.count() <= BROADCAST:
        return docs.withColumn(key, hashes).join(F.broadcast(found), key, "left").withColumn(spans, every).drop(key, named)
    low = F.lower(text)
    anchored = F.lit(False)
    for g in rare:
        anchored |= F.contains(low, F.lit(g))
    far = docs.where(~anchored).withColumn(spans, F.array_sort(rest))
    near = docs.where(anchored).withColumn(key, hashes).join(found, key, "left").withColumn(spans, every).drop(key, named)
    return far.unionByName(near)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts and digests of ``scan``."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return scan(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of every rule replaced by ``mask``; overlapping spans are replaced once, all columns stay."""
    found, spans = scan(docs), spans_column(docs)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        until = F.greatest(acc["at"], s["end"])
        kept = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(until.alias("at"), F.when(fresh, F.concat(acc["out"], kept, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    cleaned = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size(spans) > 0, cleaned).otherwise(F.col("text"))).select(*docs.columns)
