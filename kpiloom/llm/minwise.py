"""Near duplicates by chosen-path set similarity join on shingle sets.

Texts with the same words form one class, and one document of each class is joined. Every document has a signature of minwise
tokens of its shingle set. In each of several independent trees a node chooses one or two signature positions by its own path
and branches its documents by their tokens there. Similar documents share most tokens and so stay together on some path; all
others fall apart at once. Nodes with few documents are compared exhaustively. In a larger node all documents are compared
with one of them, its pivot; if few are still in other components than the pivot, these are compared with all and the node is
done, since the others are one component already. Else the node branches on, several steps before its pivots are compared again;
nodes that become small at a step between are compared exhaustively too. Nodes left at the last level are finished in the
same exact way, whatever their size. Links are confirmed on the full shingle sets, and components of links are found by repeated joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import sized_slices, written

SHINGLE, PERCENT = 4, 80
#: Target: a pair at the limit whose nodes stay large to the deepest level (depth 11) is missed by all trees with less than 0.15%, averaged
#: over how many positions of the signature agree (64 positions and 10 trees: 5.0%; 128 and 24: 0.146%).
SIGNATURE, TREES = 128, 24
#: Branchings of a large node between one comparison and the next.
STEPS = (2, 4, 4)
#: Documents of a node that are compared all with all.
LEAF = 24
#: Documents outside the pivot's component that are compared with their whole node; more let the node branch on. No document meets
#: more by their sketches in a node, which costs less than the branchings it spares; the few pairs left are judged once.
LEFT_OVER = 512
#: Pairs that one task confirms at a time.
TASK_PAIRS = 2_000
#: At most so many ids are sent to all tasks.
SENT_IDS = 500_000
#: Tokens that two signatures must share for an exact comparison: five standard deviations below what the limit makes likely.
MIN_SHARED = int(SIGNATURE * PERCENT / 100 - 5 * (SIGNATURE * PERCENT * (100 - PERCENT)) ** 0.5 / 100)
#: Tokens whose lowest bits may differ: those of two signatures at the limit differ in every tenth place on average; five deviations more.
MAX_DIFFER = int(SIGNATURE * (100 - PERCENT) / 200 + 5 * (SIGNATURE * (100 - PERCENT) * (100 + PERCENT)) ** 0.5 / 200) + 1
BITS = ("bits0", "bits1")
#: What a document's row in a node carries.
CARRIED = ("id", "size", *BITS)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = SHINGLE) -> tuple[list[np.ndarray], list[bytes]]:
    """The distinct hashed shingles of each text, sorted, and its words in lower case joined by single blanks."""
    words = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    joined = [b" ".join(w) for w in words]
    data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    # hash of a word: the sum of its bytes times powers of an odd base, from differences of running sums
    powers = np.cumprod(np.full(len(data), _BASE, np.uint64)) if len(data) else np.zeros(0, np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)))
    blanks = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], blanks[:-1] + 1)) if len(blanks) else np.zeros(0, np.int64)
    full = blanks > starts
    starts, ends = starts[full], blanks[full]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.cumprod(np.full(len(data), inverse, np.uint64)) if len(data) else powers
    hashed = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    sets, at = [], 0
    for w in words:
        own = hashed[at : at + len(w)]
        at += len(w)
        n = len(own) - size + 1
        if n > 0:
            mixed = np.zeros(n, np.uint64)
            for i in range(size):
                mixed = _mix(mixed * np.uint64(3) + own[i : i + n])
            sets.append(np.unique(mixed))
        else:
            mixed = np.zeros(1, np.uint64)
            for h in own:
                mixed = _mix(mixed * np.uint64(5) + h)
            sets.append(mixed if len(own) else mixed[:0])
    return sets, joined


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signature(shingles: np.ndarray, n: int = SIGNATURE) -> np.ndarray:
    """The minwise token of the set under each of ``n`` orders, 32 bits."""
    seeds = _seeds(n)
    flips, factors = ((seeds >> np.uint64(32)).astype(np.uint32)[:, None], (seeds.astype(np.uint32) | np.uint32(1))[:, None])
    low = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(short), 1024):
        ordered = short[at : at + 1024] ^ flips
        np.multiply(ordered, factors, out=ordered)
        np.minimum(low, ordered.min(axis=1), out=low)
    return (_mix(low.astype(np.uint64) + seeds) >> np.uint64(32)).astype(np.uint32)


def sketch(tokens: np.ndarray) -> tuple[int, int]:
    """The lowest bit of each of the signature's tokens, as two longs."""
    halves = np.packbits((tokens & np.uint32(1)).astype(np.uint8)).view(">i8")
    return int(halves[0]), int(halves[1])


def profiles(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Key, number of shingles, a hash of the words and the signature (empty for an empty set) of each document."""
    from hashlib import blake2b

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, "text", 250_000):
            sets, joined = shingle_sets([t or "" for t in batch.column("text").to_pylist()], shingle)
            tokens = [signature(s) if len(s) else np.zeros(0, np.uint32) for s in sets]
            columns = [
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([blake2b(j, digest_size=16).digest() if len(s) else None for j, s in zip(joined, sets, strict=True)], pa.binary()),
                pa.array([t.view(np.int32) for t in tokens], pa.list_(pa.int32())),
                *(pa.array([sketch(t)[k] if len(t) else 0 for t in tokens], pa.int64()) for k in (0, 1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "words", "tokens", *BITS])

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(describe, "doc_id bigint, n_shingles bigint, words binary, tokens array<int>, bits0 bigint, bits1 bigint")


def _over_node(figure: Column) -> Column:
    """A figure of the row's node; rows are dealt to their nodes once, where a join with the nodes' figures would deal both."""
    return figure.over(Window.partitionBy("node"))


def _branches(path: Column) -> Column:
    """The one or two signature positions that a node chooses: 1.25 on average, the inverse of the limit."""
    draw = lambda salt: F.pmod(F.xxhash64(path, F.lit(salt)), F.lit(SIGNATURE)).cast("int")
    second = F.pmod(F.xxhash64(path, F.lit(2)), F.lit(100)) < (100 * 100 // PERCENT - 100)
    return F.when(second, F.array(draw(0), draw(1))).otherwise(F.array(draw(0)))


def _branched(rows: DataFrame, representatives: DataFrame, steps: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """Branch rows of ``node`` and what is carried by the tokens at the positions that their nodes choose, some steps at once.

    Also returns the rows of nodes that become small before the last step, or None after one step: they branch no more, as whoever
    meets in such a node is compared there. Signatures stay with their documents; a step joins them for the chosen token only.
    """
    ended, tokens = None, representatives.select("id", "tokens")
    for step in range(steps):
        chosen = rows.select("node", *CARRIED, F.explode(F.array_distinct(_branches(F.col("node")))).alias("place"))
        rows = chosen.join(tokens, "id").select(F.xxhash64("node", "place", F.get("tokens", F.col("place"))).alias("node"), *CARRIED)
        if step < steps - 1:
            met = written(rows.withColumn("n", _over_node(F.count(F.lit(1)))).filter("n > 1"), "path-steps")
            small, rows = met.filter(F.col("n") <= LEAF).drop("n"), met.filter(F.col("n") > LEAF).drop("n")
            ended = small if ended is None else ended.union(small)
    return rows, ended


def _roots(representatives: DataFrame, trees: int) -> DataFrame:
    """The first branching of every tree, which needs no join."""
    tree = F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")
    rows = representatives.select(*CARRIED, "tokens", tree).select(F.xxhash64(F.lit("tree"), "tree").alias("node"), *CARRIED, "tokens")
    chosen = rows.select("node", *CARRIED, "tokens", F.explode(F.array_distinct(_branches(F.col("node")))).alias("place"))
    return chosen.select(F.xxhash64("node", "place", F.get("tokens", F.col("place"))).alias("node"), *CARRIED)


def _sketches_allow(x: str, y: str) -> Column:
    """Whether the lowest bits of two signatures are near enough, by a chance of about one in three million against a link."""
    differ = [F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in BITS]
    return differ[0] + differ[1] <= MAX_DIFFER


def _sizes_allow(x: Column, y: Column) -> Column:
    """Whether sets of these sizes can be similar enough at all: the smaller one would have to lie whole in the larger."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _pairs_of(a: DataFrame, b: DataFrame, meet: Column) -> DataFrame:
    """Pairs (``a`` < ``b``) of documents that share a node, lie in different components so far and satisfy ``meet``."""
    columns = ("node", *CARRIED, "component")
    x, y = a.select(*columns).alias("x"), b.select(*columns).alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & _sizes_allow(F.col("x.size"), F.col("y.size")) & _sketches_allow("x.", "y.")
    both = x.join(y, (F.col("x.node") == F.col("y.node")) & apart & meet)
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _confirmed(pairs: DataFrame, representatives: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough.

    Signatures first rule out pairs that cannot reach the limit but by a chance of about one in three million. A text that many
    pairs share is turned into its set once for each batch of pairs.
    """
    near = pairs.join(representatives.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    near = near.join(representatives.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.aggregate(F.zip_with("ta", "tb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    near = written(near.filter(shared >= MIN_SHARED).select("a", "b"), "path-pairs")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    size = near.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(ids.agg(F.count(F.lit(1)).alias("ids"))).first()  # one row each
    if size.pairs == 0:
        return near
    # few ids go to the scan of the texts, so that only needed texts are shuffled; more than the bound are joined by a shuffle
    needed = texts.join(F.broadcast(ids) if size.ids <= SENT_IDS else ids, "id", "left_semi")
    texts = needed.groupBy("id").agg(F.min("text").alias("text"))  # repeated keys count as one document
    # a number of tasks by pairs, as pairs with their texts are far larger than both sides of the joins
    tasks = 1 + size.pairs // TASK_PAIRS
    rows = near
    for k in ("b", "a"):
        rows = rows.repartition(tasks, k).join(texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")).repartition(tasks, k), k)
    rows = rows.select("a", "b", "ta", "tb")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(sized_slices(batches, "tb", 500_000), "ta", 500_000):
            sides = [_sets_by_key(batch.column(k), batch.column(t), shingle) for k, t in (("a", "ta"), ("b", "tb"))]
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                first, second = sides[0][a], sides[1][b]
                shared = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(first) + len(second) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(confirm, "a bigint, b bigint")


def _unjudged(pairs: DataFrame, judged: list[DataFrame]) -> DataFrame:
    """The pairs that were not among those ``judged`` before; they are judged from now on."""
    for before in judged:
        pairs = pairs.join(before, ["a", "b"], "left_anti")
    judged.append(written(pairs, "path-judged"))
    return judged[-1]


def _sets_by_key(keys: pa.Array, texts: pa.Array, shingle: int) -> dict[int, np.ndarray]:
    """The shingle set of each distinct key; each text is turned into its set once."""
    at = {k: i for i, k in reversed(list(enumerate(keys.to_pylist())))}
    return dict(zip(at, shingle_sets(texts.take(pa.array(list(at.values()), pa.int64())).to_pylist(), shingle)[0], strict=True))


def _in_components(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Add the component of each document; one without links so far is its own."""
    if known is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))


def links(representatives: DataFrame, texts: DataFrame, trees: int = TREES, steps: tuple[int, ...] = STEPS, shingle: int = SHINGLE) -> DataFrame:
    """Confirmed links (``a`` < ``b``) between documents: enough of them to connect every component the trees find.

    ``representatives`` has ``id``, ``size`` (of the set), ``tokens`` and their bits of documents with different words, ``texts`` their ``id`` and ``text``. What
    lies in one component already is not compared again, and nodes that hold one component only are done. Between two
    comparisons a node that is still large branches as many ``steps`` as that level tells. A pair is judged once, however many
    nodes it meets in.
    """
    rows, known, new, ended, judged = _roots(representatives, trees), None, [], None, []
    for level in range(len(steps) + 1):
        # the smallest document is the first pivot of all trees, so that they share its pairs; deeper nodes draw theirs
        order = F.col("id") if level == 0 else F.xxhash64("node", "id")
        rows = _in_components(rows, known)
        lead = F.min_by(F.struct(F.col("id").alias("pivot"), F.col("size").alias("pivot_size"), F.col("component").alias("main"), *(F.col(b).alias(f"pivot_{b}") for b in BITS)), F.struct(order, "id"))
        figures = {"n": F.count(F.lit(1)), "lo": F.min("component"), "hi": F.max("component"), "lead": lead}
        rows = rows.select("*", *(_over_node(f).alias(name) for name, f in figures.items())).filter("lo < hi")
        rows = written(rows.select("node", *CARRIED, "component", "n", "lead.*"), "path-nodes")
        small, large = rows.filter(F.col("n") <= LEAF), rows.filter(F.col("n") > LEAF)
        near = (F.col("component") != F.col("main")) & _sizes_allow(F.col("size"), F.col("pivot_size")) & _sketches_allow("", "pivot_")
        star = large.filter(near).select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))
        if ended is not None:
            small = small.select("node", *CARRIED, "component").union(_in_components(ended, known).select("node", *CARRIED, "component"))
        pairs = _pairs_of(small, small, F.col("x.id") < F.col("y.id")).union(star).distinct()
        new.append(written(_confirmed(_unjudged(pairs, judged), representatives, texts, shingle), "path-links"))
        if large.isEmpty():
            break
        known = components(_all_links(new, known))
        new = []
        placed = _in_components(large.select("node", "pivot", *CARRIED), known)
        placed = placed.withColumn("main", _over_node(F.max(F.when(F.col("id") == F.col("pivot"), F.col("component")))))
        placed = placed.withColumn("left_over", _over_node(F.count(F.when(F.col("component") != F.col("main"), 1))))
        placed = written(placed.filter("left_over > 0"), "path-large")
        done = F.lit(level == len(steps)) | (F.col("left_over") <= LEFT_OVER)
        rest = placed.filter(done & (F.col("component") != F.col("main")))
        new.append(written(_confirmed(_unjudged(_pairs_of(rest, placed.filter(done), F.lit(True)), judged), representatives, texts, shingle), "path-links"))
        on = placed.filter(~done)
        if on.isEmpty():
            break
        rows, ended = _branched(on.select("node", *CARRIED), representatives, steps[level])
    return _all_links(new, known)


def _all_links(new: list[DataFrame], known: DataFrame | None) -> DataFrame:
    """New links and, for components known before, a link of each document to the smallest one."""
    out = None if known is None else known.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    for rows in new:
        out = rows if out is None else out.union(rows)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``component``) of every node of the links, the smallest id of what it is connected with.

    Links are turned alternately into links of each node to its smallest neighbour among all and among the smaller ones, until
    nothing changes; the number of links never grows.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.filter("u <> v").distinct(), "component-links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", trees: int = TREES, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row; shingles have so many words.

    Documents without words, and null texts, are linked with nothing. Rows with equal keys count as one document for links but
    are all returned; a null key is never linked by similarity and keeps itself.
    """
    described = written(profiles(documents, key, text, shingle), "shingle-profiles")
    filled = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("words").agg(F.min("doc_id").alias("id"))
    members = filled.select("doc_id", "words", "n_shingles", "tokens", *BITS).join(classes, "words")
    representatives = written(
        members.filter("doc_id = id").groupBy("id").agg(F.min(F.struct(F.col("n_shingles").cast("int").alias("size"), "tokens", *BITS)).alias("own")).select("id", "own.*"),
        "representatives",
    )
    texts = documents.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    joined = components(links(representatives, texts, trees, shingle=shingle))
    of_class = classes.join(joined, "id", "left").select("words", F.coalesce("component", "id").alias("component_id"))
    rows = described.join(of_class, "words", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One document of each group: the one with the smallest key, all columns."""
    judged = near_duplicates(documents, key, text, shingle=shingle)
    dropped = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    return documents.join(dropped, documents[key].cast("bigint") == dropped["id"], "left_anti")
