"""Personal data in whole texts, with DataFrame functions only.

Four kinds have exact patterns. From them the contextual part starts: every match is a seed, and so is a token with digits behind
a written label such as ``token =`` or ``account no.``. The word before a seed (with what is attached in front of it) is a lexical
pattern, and tokens that look like identifiers and stand behind the same pattern are instances too. Scores run over the graph of
patterns and instances: a pattern is as sure as the share of its word's occurrences in the whole corpus that stand before sure
instances, an instance as sure as its patterns together. Sure instances induce patterns in turn, until no new one appears.
Labelled tokens and those behind high-confidence patterns are new findings of the kind ``id``, unless they overlap a base match.

Defined results: a null text is empty and has no findings; rows that repeat get the same findings; an empty table has none; other
columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import whole_text, written

# Fixed patterns of the four kinds. Possessive quantifiers and the tests of the character before only spare the engine attempts
# that cannot succeed: a run of local characters or digits fails as a whole or not at all.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind to be possible.
_NEEDED = {"email": "@", "ip": ".", "phone": "+"}
#: Tokens with digits that may be identifiers; no part of an address.
CANDIDATE = r"(?<![A-Za-z0-9_@.%+-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+(?![@]|\.[A-Za-z0-9])"
#: Written labels right before an identifier.
LABEL = (
    r"(?i)(?<![A-Za-z0-9])(?:access[ _-]?key|account|api[ _-]?key|iban|licen[cs]e|passport|passw(?:or)?d|passwd|secret|ssn|token)[\"']?"
    r"\s*(?:[:=#]|no\.|number:?)\s*[\"'(]*$"
)
DISCOVERED = "id"
_BLANK, _VISIBLE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Code points before a match that are searched first; where the word is not whole there, all text after the match before is.
CONTEXT = 64
_BLOCK = 256

#: Scorings of the graph after each induction.
ROUNDS, MIN_CONFIDENCE, MIN_SEEDS = 3, 0.5, 2


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, also where ``then`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def prefix_sums(steps: Column) -> Column:
    """Running totals of an array of integers, in blocks, so that long arrays take far less than quadratic time."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def in_blocks(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: total(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK))))
        bases = let(totals, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))))
        return let(bases, lambda base: F.transform(
            s, lambda _, i: F.get(base, F.floor(i / _BLOCK).cast("int"))
            + total(F.slice(s, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1)),
        ))

    return let(steps, in_blocks)


def _parts(text: Column, pattern: str, needed: str | None) -> Column:
    """Matches of a pattern and the text between them: one array more of gaps than of hits, or null without a match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(hits, lambda h: F.when(F.size(h) > 0, F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("gaps"))))
    return F.when(F.contains(text, F.lit(needed)), found) if needed else found


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: part.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & let(F.split(F.reverse(digits), ""), _luhn)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == DISCOVERED:
        return F.length(digits) >= 3
    return F.lit(True)


def _luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    numbers = F.transform(F.filter(digits, lambda d: d != ""), value)
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b) % 10 == 0


def found_in(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, start, end, value, word, attached, labelled) of the valid matches; null if there are none at all.

    Positions are code points, the end exclusive. ``word`` is the blank-delimited word before the match and ``attached`` what
    stands between; they are null where no word lies between the match and the one before it.
    """

    def located(p: Column) -> Column:
        hits, gaps = p["hits"], p["gaps"]
        steps = F.transform(hits, lambda _, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(hits, i - 1)), F.lit(0)))
        before = rf"({_VISIBLE}+){_BLANK}+({_VISIBLE}*)$"
        inside, anywhere = rf"^(?s:.*?){_BLANK}{before}", rf"^(?s:.*?){before}"

        def span(start: Column, i: Column) -> Column:
            hit, gap = F.get(hits, i), F.get(gaps, i)
            near = F.right(gap, F.lit(CONTEXT))

            def context(group: int) -> Column:
                return F.when(near.rlike(inside), F.regexp_extract(near, inside, group)).when(gap.rlike(anywhere), F.regexp_extract(gap, anywhere, group))

            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"),
                F.lower(context(1)).alias("word"), context(2).alias("attached"),
                (near.rlike(LABEL) if kind == DISCOVERED else F.lit(False)).alias("labelled"),
            )

        return let(prefix_sums(steps), lambda starts: F.filter(F.transform(starts, span), lambda s: _valid(kind, s["value"])))

    return let(_parts(text, pattern, _NEEDED.get(kind)), lambda p: F.when(p.isNotNull(), located(p)))


SPAN = "array<struct<kind:string,start:int,end:int,value:string,word:string,attached:string,labelled:boolean>>"


def with_spans(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_spans`` (valid matches of the four kinds, by kind as listed, then by start) and ``_candidates``."""
    none = F.array().cast(SPAN)
    value = whole_text(text)
    each = [F.coalesce(found_in(value, kind, pattern), none).cast(SPAN) for kind, pattern in KINDS.items()]
    candidates = F.coalesce(found_in(value, DISCOVERED, CANDIDATE), none).cast(SPAN)
    both = documents.withColumns({"_spans": F.concat(*each), "_candidates": candidates})
    apart = F.filter("_candidates", lambda c: ~F.exists("_spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    return both.withColumn("_candidates", apart)


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """How often each blank-delimited word, in lower case, occurs in all texts."""
    words = F.explode(F.split(F.lower(whole_text(text)), rf"{_BLANK}+"))
    return documents.select(words.alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("in_corpus"))


def confident_patterns(
    found: DataFrame, corpus_words: DataFrame, rounds: int = ROUNDS, confidence: float = MIN_CONFIDENCE, seeds: int = MIN_SEEDS,
) -> DataFrame:
    """Patterns (``word``, ``attached``, ``confidence``) that enough distinct seeds stand behind and that stay sure.

    ``found`` has ``_spans`` and ``_candidates``. Counts are combined per pattern and instance before anything is shuffled or
    joined, so a frequent context is one row for each of its distinct instances.
    """
    rows = found.select(F.explode(F.concat("_spans", "_candidates")).alias("s")).select("s.*").filter("word IS NOT NULL")
    seed = (F.col("kind") != DISCOVERED) | F.col("labelled")
    edges = written(rows.groupBy("word", "attached", "value").agg(F.count(F.lit(1)).alias("n"), F.max(seed).alias("seed")), "pii-edges")
    first = edges.groupBy("value").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("score"))
    scores, patterns, known = first, None, -1
    while True:
        sure = scores.filter(F.col("score") >= confidence).select("value")
        induced = edges.join(sure, "value").groupBy("word", "attached").agg(F.count(F.lit(1)).alias("sure")).filter(F.col("sure") >= seeds)
        used = induced.join(corpus_words, "word").select("word", "attached", "in_corpus")
        if patterns is not None:  # what was induced once stays, so the number of patterns only grows
            used = used.unionByName(graph.select("word", "attached", "in_corpus")).distinct()
        graph = written(edges.join(used, ["word", "attached"]), "pii-graph")
        now = graph.select("word", "attached").distinct().count()
        if now == known:
            return patterns.filter(F.col("confidence") >= confidence)
        known = now
        for _ in range(rounds):
            weighed = graph.join(scores, "value").groupBy("word", "attached").agg(
                F.least(F.lit(1.0), F.sum(F.col("score") * F.col("n")) / F.max("in_corpus")).alias("confidence")
            )
            patterns = written(weighed, "pii-patterns")
            doubt = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence"))))
            behind = graph.join(patterns, ["word", "attached"]).groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(doubt)).alias("score"))
            scores = first.filter(F.col("score") > 0).unionByName(behind).groupBy("value").agg(F.max("score").alias("score"))


def discovered(found: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """Per document (its key and a hash of its text) the candidates behind confident patterns, by start."""
    rows = found.filter(F.size("_candidates") > 0).select(F.col(key).alias("key"), F.col("_hash").alias("hash"), F.explode("_candidates").alias("s"))
    rows = rows.select("key", "hash", "s.*").join(patterns, ["word", "attached"], "left").filter(F.col("labelled") | F.col("confidence").isNotNull())
    new = F.struct("kind", "start", "end", "value", "word", "attached", "labelled")
    return rows.groupBy("key", "hash").agg(F.array_sort(F.collect_set(new)).alias("_discovered"))


def _free(name: str, columns: list[str]) -> str:
    """The name with underscores in front until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def find(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add two columns to all rows: ``_spans`` (base) and ``_discovered``, with more underscores where a name is taken.

    They are the last two, where ``report`` and ``redact`` look for them. Repeated rows with equal key and text get the same
    findings. The table of findings is written once.
    """
    slim = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    scanned = with_spans(slim).withColumn("_hash", F.xxhash64("text"))
    small = written(scanned.select("key", "_hash", "_spans", "_candidates").filter(F.size("_candidates") + F.size("_spans") > 0), "pii-found")
    new = discovered(small, confident_patterns(small, word_counts(slim)), "key")
    per_row = small.select("key", "_hash", "_spans").dropDuplicates(["key", "_hash"]).alias("b")
    both = per_row.join(new.alias("d"), F.col("b.key").eqNullSafe(F.col("d.key")) & (F.col("b._hash") == F.col("d.hash")), "left")
    both = both.select(F.struct(F.col("b.key").alias("key"), F.col("b._hash").alias("hash")).alias("of"), "_spans", "_discovered")
    # the documents' columns go as one struct, so that none of their names can clash
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"))
    here = F.struct(F.col(f"row.`{key}`").alias("key"), F.xxhash64(F.col(f"row.`{text}`")).alias("hash"))
    joined = rows.join(both, here.eqNullSafe(F.col("of")), "left")
    none = F.array().cast(SPAN)
    names = [_free(n, documents.columns) for n in ("_spans", "_discovered")]
    return joined.select("row.*", *(F.coalesce(n, none).alias(name) for n, name in zip(("_spans", "_discovered"), names, strict=True)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per kind, a digest of the base spans and the list of all spans of each document."""
    spans, new = found.columns[-2:]
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        key, *map(count, KINDS), F.sha2(_listed(F.col(spans)), 256).alias("base_sha256"), _listed(F.concat(spans, new)).alias("spans"),
    )


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Put ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` or ``[ID]`` in place of what was found; other columns stay.

    Kinds go in the order listed; what a kind has replaced is no longer seen by the next.
    """
    spans, new = found.columns[-2:]
    touched = F.size(spans) + F.size(new) > 0
    value = F.col(text)
    for kind, pattern in [*KINDS.items(), (DISCOVERED, CANDIDATE)]:
        wanted = F.transform(F.filter(new, lambda s: s["kind"] == kind), lambda s: s["value"])
        value = let(value, _replacing(kind, pattern, wanted))
    clean = F.when(touched, value).otherwise(F.col(text))
    return found.withColumn(text, clean).drop(spans, new)


def _replacing(kind: str, pattern: str, wanted: Column) -> Callable[[Column], Column]:
    def rebuilt(p: Column) -> Column:
        def piece(gap: Column, i: Column) -> Column:
            hit = F.get(p["hits"], i)
            found = F.array_contains(wanted, hit) if kind == DISCOVERED else _valid(kind, hit)
            return F.concat(gap, F.when(hit.isNull(), "").when(found, f"[{kind.upper()}]").otherwise(hit))

        return F.array_join(F.transform(p["gaps"], piece), "")

    def replaced(text: Column) -> Column:
        return let(_parts(text, pattern, _NEEDED.get(kind)), lambda p: F.when(p.isNotNull(), rebuilt(p)).otherwise(text))

    return replaced
