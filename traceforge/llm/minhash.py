"""Near-duplicates by a signature-coordinate inverted join.

Every document has a MinHash signature; a coordinate and its value are a posting key. Two documents of similarity s
agree in about s of the coordinates, so those that agree in fewer than a threshold are no candidates. Rare keys come
first: a document that is to agree in t of K coordinates with another shares one of its K - t + 1 rarest keys with it,
so only those are posted (prefix), and keys that nobody else has are skipped. Collisions are counted where two postings
of a list meet; candidates are confirmed on full sets.

Groups of near copies are kept from meeting in all pairs: each has a pivot, and its members are known by their difference
from it, which tells most pairs of a group apart without making them (see links_inside).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, saved, slices, tune

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Shingler:
    """Distinct shingles of whole texts as sorted 64-bit hashes: A-Z lower-cased, words split at \\x20 and \\x09-\\x0D."""

    def __init__(self, width: int = 5, limit: int = 400_000):
        self.width, self.limit = width, limit
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(words))
        out = np.full(len(words) - n + 1, np.uint64(n))
        for k in range(n):
            out ^= h[k : k + len(out)]
            out *= _MIX[k % 5]
            out ^= out >> np.uint64(31)
        return np.unique(out)


def coefficients(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, (k, 1), np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, (k, 1), np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest of the upper 32 bits of a * x + b over the set, for each pair of coefficients."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        best = np.minimum(best, (a * s[i : i + 2048] + b).min(1))
    return (best >> np.uint64(32)).astype(np.uint32)


#: Coordinates of which one bit each is kept, to refute candidates before their sets are read.
BIT_COORDINATES = 1024
#: Percent of similarity from which a pivot is a node's home.
NEAR = 50
#: Pivots are chosen again as long as a round finds something for one node in so many.
WORTH = 50


def one_bits(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """One bit of the smallest value for each pair of coefficients, packed into longs."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 64):
        best = np.minimum(best, (a * s[i : i + 64] + b).min(1))
    return np.packbits(((best >> np.uint64(32)) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist()


def least_agreement(n: int, share: float) -> int:
    """Five standard deviations below the mean of ``n`` trials that succeed with chance ``share``."""
    return int(n * share - 5 * (n * share * (1 - share)) ** 0.5)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, k: int = 48) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, h1, h2 (128 bits of the whole set), sig (``k`` coordinates as long keys)."""
    tune(docs.sparkSession)
    schema = "doc_id long, th long, n_shingles long, h1 long, h2 long, sig array<long>"
    a, b = coefficients(k)
    place = np.arange(k, dtype=np.int64) << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(width)
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for t in batch.column(2).to_pylist():
                s = sets(t or "")
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s)), h1.append(int.from_bytes(d[:8], "little", signed=True)), h2.append(int.from_bytes(d[8:], "little", signed=True))
                sig.append(place | signature(s, a, b).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "th", "n_shingles", "h1", "h2", "sig"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), F.xxhash64(col(text_col)).alias("th"), col(text_col).alias("text")).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for all nodes of undirected ``edges`` (a, b).

    Each round every node hooks to its smallest neighbour, pointers are followed to their roots, and the edges between
    different roots are what the next round has; the number of nodes at least halves each time.
    """
    e = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).union(e.select("b", "a"))
        up = saved(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")), "parents")
        while True:
            far = up.join(up.select(F.col("n").alias("p"), F.col("p").alias("q")), "p")
            new = saved(far.select("n", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parents")
            up = new.select("n", "p")
            if new.filter("moved").isEmpty():
                break
        if labels is None:
            labels = up.select(F.col("n").alias("node"), F.col("p").alias("comp"))
        else:
            moved = up.select(F.col("n").alias("comp"), F.col("p").alias("to"))
            labels = saved(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        at = up.select(F.col("n").alias("a"), F.col("p").alias("ra"))
        bt = up.select(F.col("n").alias("b"), F.col("p").alias("rb"))
        e = saved(e.join(at, "a").join(bt, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels if labels is not None else e.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, near, linked of pairs (a, b) of nodes, by their full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    enough = lambda p: (100 + p) * F.col("i") >= p * F.col("n")
    return both.select("a", "b", enough(NEAR).alias("near"), enough(percent).alias("linked"))


class Links:
    """The links found so far and the components they make of all nodes."""

    def __init__(self, nodes: DataFrame):
        self.nodes, self.found = nodes.select("node"), None
        self.comps = self.nodes.select("node", F.col("node").alias("comp"))

    def add(self, pairs: DataFrame) -> None:
        self.found = pairs.select("a", "b") if self.found is None else self.found.unionByName(pairs.select("a", "b"))

    def join_up(self) -> None:
        if self.found is not None:
            got = components(self.found)
            self.comps = saved(self.nodes.join(got, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "components")


def homes_of(postings: DataFrame, sets: DataFrame, n: int, percent: int, links: Links) -> DataFrame | None:
    """node, home: a pivot that is at least NEAR percent similar; nodes without one are left out.

    In each round a node meets one pivot: the member with the commonest keys of all its lists, of nodes that have no
    home yet; a node whose home has found a home itself meets that one. So a round makes at most one pair per node.
    """
    homes, free = None, postings
    while True:
        order = F.struct("typical", F.xxhash64("node").alias("h"), "node", "size")
        lists = free.groupBy("key").agg(F.max(order).alias("p"), F.count("*").alias("m")).filter("m > 1").drop("m")
        fits = (F.col("node") != F.col("p.node")) & ((100 + NEAR) * F.least("size", "p.size") >= NEAR * (F.col("size") + F.col("p.size")))
        meet = free.join(lists, "key").filter(fits).groupBy(F.col("node").alias("a")).agg(F.max("p").alias("p")).select("a", F.col("p.node").alias("b"))
        if homes is not None:
            on = homes.select(F.col("node").alias("home"), F.col("home").alias("b")).filter("home <> b")
            meet = meet.unionByName(homes.join(on, "home").select(F.col("node").alias("a"), "b"))
        seen = saved(compared(meet, sets, percent), "meetings")
        told = seen.agg(F.count_if("near").alias("near"), F.count_if("linked").alias("linked")).first()
        if told["linked"]:
            links.add(seen.filter("linked"))
        if not told["near"]:
            return homes
        near = seen.filter("near")
        new = near.select(F.col("a").alias("node"), F.col("b").alias("home"))
        if homes is not None:
            new = new.unionByName(homes.join(new.select("node"), "node", "left_anti"))
        own = near.select(F.col("b").alias("node")).distinct().join(new.select("node"), "node", "left_anti").select("node", F.col("node").alias("home"))
        homes = saved(new.unionByName(own), "homes")
        if told["near"] * WORTH < n:
            return homes
        free = postings.join(homes.select("node"), "node", "left_anti")


def links_inside(homes: DataFrame, sets: DataFrame, percent: int, links: Links) -> None:
    """Adds links between the members of each home that join different components.

    A member S of a home with pivot P lacks some of P's shingles and has others: its difference D. Two members share
    |P| less what either lacks plus x shingles, where x counts what their differences have in common. So with
    f = (100 + p) |P| - 2 (100 + p) |P without S| - 2 p |S|, they are linked if f + f' + 2 (100 + p) x >= 0. Without a common
    difference both are linked to the pivot itself, as no f is larger than the pivot's. What only one member has in its
    difference is never common; of the rest (d elements) at least as many as the pair's f ask for have to be, which leaves
    out all members for which no other's f and d are high enough, and a prefix of the rarest is posted for the others.
    """
    c = 2 * (100 + percent)
    at = homes.join(links.comps, "node")
    mixed = at.groupBy("home").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("home")
    at = at.filter("node <> home").join(mixed, "home", "left_semi").select("node", "home")
    full = at.join(sets.select("node", "set"), "node").join(sets.select(F.col("node").alias("home"), F.col("set").alias("pivot")), "home")
    lacks = F.array_except("pivot", "set")
    parts = full.select("home", "node", (c // 2 * F.size("pivot") - c * F.size(lacks) - 2 * percent * F.size("set")).cast("long").alias("f"), F.concat(lacks, F.array_except("set", "pivot")).alias("diff"))
    parts = saved(parts, "differences")
    if parts.isEmpty():
        return
    each = parts.select("home", "node", F.explode("diff").alias("e"))
    common = each.groupBy("home", "e").agg(F.count("*").alias("m")).filter("m > 1")
    own = each.join(common, ["home", "e"]).groupBy("home", "node").agg(F.sort_array(F.collect_list(F.struct("m", "e"))).alias("own"))
    # elements in one order for all members, the rarest first
    held = saved(parts.drop("diff").join(own, ["home", "node"]).select("home", "node", "f", F.size("own").alias("d"), F.col("own.e").alias("own"), F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["m"]).alias("typical")), "differences")
    best = held.groupBy("home").agg(F.max("f").alias("top"), F.max(F.col("f") + c * F.col("d")).alias("reach"))
    able = held.join(best, "home").filter(F.col("f") + F.least(c * F.col("d") + F.col("top"), "reach") >= 0)
    skip = F.greatest(F.lit(1), F.ceil(-(F.col("f") + F.col("top")) / c))
    able = saved(able.withColumn("prefix", F.slice("own", F.lit(1), F.greatest(F.lit(0), F.col("d") - skip + 1).cast("int"))).filter("size(prefix) > 0").drop("own", "top", "reach"), "differences")
    n = able.count()

    def feasible(other: str):
        return F.col("f") + F.col(f"{other}.f") + c * F.least(F.col("rest"), F.col(f"{other}.rest")) >= 0

    step = quiet = 0
    while n:
        meeting = quiet < 2  # then all pairs that are left are made
        order = F.col("typical") if not step else F.xxhash64("node", F.lit(step))
        post = able.join(links.comps, "node").select("home", "node", "f", "d", "typical", "comp", F.posexplode("prefix").alias("pos", "e")).withColumn("rest", F.col("d") - F.col("pos"))
        post = saved(post.drop("d"), "postings")
        many = post.groupBy("home", "e", "comp").agg(F.count("*").alias("m"), F.max(F.struct(order.alias("order"), "node", "f", "rest", "comp")).alias("p"))
        lists = many.groupBy("home", "e").agg(F.count("*").alias("comps"), F.max("p").alias("p"), F.max_by("comp", F.struct("m", "comp")).alias("most")).filter("comps > 1")
        both = post.join(lists, ["home", "e"])
        if meeting:
            pairs = both.filter((F.col("comp") != F.col("p.comp")) & feasible("p")).groupBy(F.col("node").alias("a")).agg(F.max("p").alias("p")).select("a", F.col("p.node").alias("b"))
        else:
            few = both.filter("comp <> most").select("home", "e", F.struct("node", "f", "rest", "comp").alias("o"))
            pairs = both.join(few, (both["home"] == few["home"]) & (both["e"] == few["e"]) & (F.col("comp") != F.col("o.comp")) & feasible("o")).select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
        found = saved(compared(pairs, sets, percent).filter("linked"), "links")
        k = found.count()
        if k:
            links.add(found)
            links.join_up()
        if not meeting:
            return
        step, quiet = step + 1, 0 if 10 * k >= n else quiet + 1


def links_across(held: DataFrame, homes: DataFrame | None, sets: DataFrame, percent: int, agree: int, links: Links) -> None:
    """Adds links between members of different homes (nodes without one are their own) that join different components.

    Two postings of a list make a pair if it is the first key that they share, their sizes and one bit of 1024 further
    coordinates allow the similarity, and they collide in at least ``agree`` coordinates.
    """
    words = [f"b{i}" for i in range(BIT_COORDINATES // 64)]
    at = held.join(links.comps, "node")
    at = at.withColumn("home", F.col("node")) if homes is None else at.join(homes, "node", "left").withColumn("home", F.coalesce("home", "node"))
    # keys lie in one order for all nodes, so two nodes meet first at a key before which they share none
    before = F.transform(F.slice("prefix", F.lit(1), F.col("pos")), lambda x: F.hash(x))
    post = at.select("node", "home", "comp", "size", *words, "keys", "prefix", F.posexplode("prefix").alias("pos", "key")).withColumn("before", before).drop("pos", "prefix")
    post = saved(post, "postings")
    many = post.groupBy("key", "home").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lists = many.groupBy("key").agg(F.count("*").alias("homes"), F.max_by("home", F.struct("m", "home")).alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("homes > 1 AND lo <> hi").select("key", "most")
    both = post.join(lists, "key")
    few = both.filter("home <> most").select(F.col("key").alias("okey"), *[F.col(x).alias(f"o{x}") for x in ("node", "home", "comp", "size", "keys", "before", *words)])
    same = F.lit(BIT_COORDINATES)
    for w in words:
        same = same - F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}")))
    likely = (F.col("home") != F.col("ohome")) & (F.col("comp") != F.col("ocomp")) & (100 * F.least("size", "osize") >= percent * F.greatest("size", "osize"))
    likely = likely & (same >= least_agreement(BIT_COORDINATES, (1 + percent / 100) / 2)) & ~F.arrays_overlap("before", "obefore") & (F.size(F.array_intersect("keys", "okeys")) >= agree)
    pairs = both.join(few, (F.col("key") == F.col("okey")) & likely).select(F.least("node", "onode").alias("a"), F.greatest("node", "onode").alias("b")).distinct()
    found = saved(compared(pairs, sets, percent).filter("linked"), "links")
    if not found.isEmpty():
        links.add(found)
        links.join_up()


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, k: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, first for every row: the least row of its group (nul, doc_id, th), ids
    before null ones; null for a row without shingles."""
    agree = least_agreement(k, percent / 100)
    base = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = saved(sketches(base, "doc_id", "text", width, k), "sketches")
    rep = F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "th")
    node = F.concat(F.hex("h1"), F.lit("-"), F.hex("h2"))
    classes = saved(rows.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min(rep).alias("rep"), F.first("sig").alias("sig")).withColumn("node", node), "classes")
    keys = classes.select("node", F.explode("sig").alias("key"))
    common = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keys.join(common, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own")).filter(F.size("own") >= agree)
    nodes = saved(shared.join(classes.select("node", "rep"), "node").select("node", "rep", F.col("own.key").alias("keys"), F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("typical")), "candidates")
    texts = base.select("doc_id", F.xxhash64("text").alias("th"), "text")
    same = texts["doc_id"].eqNullSafe(F.col("rep.doc_id")) & (texts["th"] == F.col("rep.th"))
    texts = texts.join(nodes.select("node", "rep"), same).select("node", "text").dropDuplicates(["node"])
    two = coefficients(BIT_COORDINATES, 2)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(width)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices([len(t) for t in texts]):
                found = [sets(t) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) for x in found], pa.int64()), pa.array([one_bits(x, *two) for x in found], pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["node", "size", "bits", "set"])

    sets = saved(texts.mapInArrow(bits, "node string, size long, bits array<long>, set array<long>"), "candidate-sets")
    sizes = sets.select("node", "size", *[F.col("bits")[i].alias(f"b{i}") for i in range(BIT_COORDINATES // 64)])
    held = saved(nodes.join(sizes, "node").withColumn("prefix", F.slice("keys", F.lit(1), F.size("keys") - agree + 1)), "prefixes")
    links = Links(nodes)
    n = held.count()
    if n:
        homes = homes_of(saved(held.select("node", "size", "typical", F.explode("prefix").alias("key")), "postings"), sets, n, percent, links)
        links.join_up()
        if homes is not None:
            links_inside(homes, sets, percent, links)
        links_across(held, homes, sets, percent, agree, links)
    at = links.comps.join(nodes.select("node", "rep"), "node")
    least = at.groupBy("comp").agg(F.min("rep").alias("first"))
    top = at.join(least, "comp").select("node", "first")
    of_class = classes.join(top, "node", "left").select("h1", "h2", F.coalesce("first", "rep").alias("first"))
    done = rows.select("doc_id", "th", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    return done.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, k: int = 48) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    A document's set is its distinct ``width``-word shingles (fewer words: the whole sequence; none: empty, linked with
    nothing). Documents with 100 * intersection >= percent * union are linked; component_id is the smallest id reachable,
    kept says that it is the document's own. Equal sets are one class (known by 128 bits) before any pair is made; every
    link is confirmed on full sets. A link is only found if its documents agree in ``k`` coordinates and in one bit of 1024
    others at least as often as five standard deviations below the mean at the required similarity: of links that have
    just that similarity about one in 350,000 isn't (85 percent and 48 coordinates), of closer ones fewer.
    Null texts are empty. Rows with a null id are linked like others but give no component its id; one of null ids only
    has a null component_id and all its rows are kept. Rows that repeat an id count each by its own text. Other columns
    are not read; an empty table gives an empty result.
    """
    got = grouped(docs, id_col, text_col, width, percent, k)
    got = got.withColumn("component_id", F.when(F.col("first").isNotNull(), F.col("first.doc_id")).otherwise(F.col("doc_id")))
    return got.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, k: int = 48) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group of near-duplicates stays: that with the smallest id.

    Rows without words stay. Null ids come after all others; rows that share an id are told apart by their texts (the one
    with the smaller hash is first), and of rows with the same id and text one stays, that with the smallest hash.
    """
    got = grouped(docs, id_col, text_col, width, percent, k)
    first = got.filter(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th")))
    first = saved(first.groupBy("doc_id", "th").agg(F.count("*").alias("n")).unionByName(got.filter("first IS NULL").select("doc_id", "th").distinct().withColumn("n", F.lit(1).cast("long"))).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "n"), "kept")
    key = lambda side: col(id_col).cast("long").eqNullSafe(side["__id"]) & (F.xxhash64(F.coalesce(col(text_col), F.lit(""))) == side["__th"])
    again = first.filter("n > 1")
    if again.isEmpty():
        return docs.join(first, key(first), "left_semi")
    once = first.filter("n = 1")
    row = F.struct(*[col(c) for c in docs.columns])
    repeated = docs.join(again, key(again)).groupBy("__id", "__th").agg(F.min_by(row, F.xxhash64(*[col(c) for c in docs.columns])).alias("__row"))
    return docs.join(once, key(once), "left_semi").unionByName(repeated.select("__row.*"))
