"""N-gram Jaccard join (1): a grouped prefix join over word shingles, and the components of its links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codes import BASES, Runs, mix, signed, word_codes, words
from .common import bucketed, identified, join_classes, own_ids, written
from .components import components

#: Words of a shingle, and the least similarity of a link as a share of 100.
SHINGLE, SIMILARITY = 5, 80
#: Shingles that a map task folds at once.
FOLD = 1_000_000
#: A shingle is known as common from this many documents, and so many of the most common are known at most. They come
#: last in the order that prefixes are taken in; which are known changes the work, not the result.
COMMON, KNOWN = 32, 1 << 17
#: A bit for each value of a token's high bits tells most tokens that are not known.
MARK_SHIFT = np.uint64(44)
#: Documents compared with one copy of their leader.
PER_LEADER = 64
#: Rounds that compare each group with one leader of each of its tokens. More or fewer change the work, not the result.
ROUNDS = 4
#: Sets of a token that one task compares with as many others.
BLOCK = 512
#: Bits of a bitmap, as powers of two: four for each shingle between these bounds.
LEAST_BITS, MOST_BITS = 8, 15


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle, one without words has none."""
    codes = word_codes(words(text, lower=True))
    runs = Runs(codes)
    every = runs.every(min(n, len(codes))) if len(codes) else np.empty(0, np.uint64)
    return np.unique(every)


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles: two sums of its members' bits, mixed differently."""
    one = mix(found)
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(mix(one + np.uint64(BASES[1])).sum(dtype=np.uint64).view(np.int64))


def bitmap(found: np.ndarray) -> bytes:
    """The parity of the number of shingles that fall on each bit. Bitmaps of two sets differ in no more bits than the sets have members apart."""
    bits = 1 << min(max(LEAST_BITS, int(4 * len(found)).bit_length()), MOST_BITS)
    return np.packbits(np.bincount((mix(found) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) as they would be with fewer bits."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of bytes differ; widths may differ."""
    width = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count((folded(a, width) ^ folded(b, width)).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def similar(both, a, b, similarity: int):
    """100 I >= s U, U = A + B - I."""
    return 100 * both >= similarity * (a + b - both)


def prefix_length(n: int, similarity: int) -> int:
    """Two sets as similar share one of so many first members, whatever the order."""
    return n - -(-similarity * n // 100) + 1


def measured(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n, d1, d2 of every document; and rows without doc_id of shingles that several sets of a fold have: token, count."""

    def run(batches):
        sets, seen, held = [], set(), 0

        def common():
            token, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            token, count = signed(token[count > 1]), count[count > 1]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token), pa.array(count)], ["doc_id", "n", "d1", "d2", "token", "count"])

        for b in batches:
            rows = []
            for text in b["text"]:
                found = shingles(text.as_py(), n)
                key = digest(found)
                rows.append((len(found), *key))
                if key not in seen:
                    seen.add(key)
                    sets.append(found)
                    held += len(found)
                if held >= FOLD:
                    yield common()
                    sets, seen, held = [], set(), 0
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), none, none], ["doc_id", "n", "d1", "d2", "token", "count"])
        yield common()

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, token long, count long")


PREFIXES = "token long, group_id long, size int, place int, d1 long, d2 long"


def prefixes(docs: DataFrame, n: int, similarity: int, known: list) -> DataFrame:
    """token, group_id, size, place of the prefixes of every group, and membership rows without place: group_id, d1, d2.

    A group is the sets of one size and prefix. Tokens are ordered by how common
    they are known to be (in powers of two), then by hash; the size of a known
    token's row is negative. A map task gives a group's tokens once.
    """
    order = np.argsort(np.array([k["token"] for k in known], np.int64).view(np.uint64))
    tokens = np.array([k["token"] for k in known], np.int64).view(np.uint64)[order]
    ranks = np.log2(np.array([k["count"] for k in known], float)).astype(np.int8)[order] if known else np.empty(0, np.int8)
    sent = docs.sparkSession.sparkContext.broadcast((tokens, ranks))  # KNOWN of them at most

    def run(batches):
        tokens, ranks = sent.value
        marks = np.zeros(1 << (64 - int(MARK_SHIFT)), bool)
        marks[tokens >> MARK_SHIFT] = True
        seen, given, out = set(), set(), []
        for b in batches:
            for text in b["text"]:
                found = shingles(text.as_py(), n)
                key = digest(found)
                if not len(found) or key in seen:
                    continue
                seen.add(key)
                size, k = len(found), prefix_length(len(found), similarity)
                first, common = found[:k], 0
                near = np.flatnonzero(marks[found >> MARK_SHIFT])
                if len(near):
                    at = np.minimum(np.searchsorted(tokens, found[near]), len(tokens) - 1)
                    same = tokens[at] == found[near]
                    near, at = near[same], at[same]
                    # the rare ones in order of hash, then the known ones
                    last = found[near[np.argsort(ranks[at], kind="stable")]]
                    first = np.concatenate([np.delete(found, near)[:k], last])[:k]
                    common = max(0, k - (size - len(near)))
                group = int((mix(first + np.uint64(size)).sum(dtype=np.uint64)).view(np.int64))
                sizes = np.full(k, size, np.int32)
                sizes[k - common :] = -size
                if group in given:
                    first, sizes = first[:0], sizes[:0]
                given.add(group)
                out.append((signed(first), np.full(len(first), group), sizes, np.arange(len(first), dtype=np.int32), (*key, group, size)))
                if len(out) >= 2000:
                    yield batch(out)
                    out = []
            if len(seen) > 100_000:
                seen, given = set(), set()
        if out:
            yield batch(out)

    def batch(out):
        d1, d2, group = (np.array([x[4][i] for x in out], np.int64) for i in range(3))
        members = [d1 ^ d2, group, np.array([x[4][3] for x in out], np.int32)]
        columns = [np.concatenate([*(x[i] for x in out), members[i]]) for i in range(3)]
        none = pa.nulls(len(out), pa.int32())
        place = pa.concat_arrays([pa.array(np.concatenate([x[3] for x in out])), none])
        blank = pa.nulls(len(columns[0]) - len(out), pa.int64())
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), place, *(pa.concat_arrays([blank, pa.array(k)]) for k in (d1, d2))], ["token", "group_id", "size", "place", "d1", "d2"])

    return docs.mapInArrow(run, PREFIXES)


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """The prefix rows whose token another group may have, and all membership rows.

    Known tokens are common, so their rows need not meet and are dealt by group;
    what is left of a token has at most the share of a shingle that is not among
    the KNOWN most common ones.
    """
    deal = F.when(F.col("size") < 0, F.xxhash64("token", "group_id")).otherwise(F.col("token"))
    by_token, group = Window.partitionBy("deal"), F.when(F.col("place").isNotNull(), F.col("group_id"))
    met = rows.withColumn("deal", deal).repartition("deal").withColumn("one", F.min(group).over(by_token)).withColumn("other", F.max(group).over(by_token))
    return met.where("place IS NULL OR size < 0 OR one <> other").select("token", "group_id", F.abs("size").cast("int").alias("size"), "place", "d1", "d2")


def possible(a: str, b: str, similarity: int):
    """Whether sets that share a token at these places, their first common one, can be similar: 100 I >= s U, U = A + B - I."""
    least = F.ceil(similarity * (F.col(f"{a}.size") + F.col(f"{b}.size")) / (100 + similarity))
    return least <= F.least(F.col(f"{a}.size") - F.col(f"{a}.place"), F.col(f"{b}.size") - F.col(f"{b}.place"))


def described(texts: DataFrame, n: int) -> DataFrame:
    """rep, n, bits, text of the sets of texts (doc_id, text)."""

    def run(batches):
        for b in batches:
            found = [shingles(t.as_py(), n) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(len, found), pa.int64()), pa.array(map(bitmap, found), pa.binary()), b["text"]], ["rep", "n", "bits", "text"])

    return texts.mapInArrow(run, "rep long, n long, bits binary, text string")


def streamed(pairs: DataFrame, sets: DataFrame, what: str, read, similarity: int) -> DataFrame:
    """The pairs (a, b) of sets that pass, by the column `what` of sets; read(n, what) gives an object with a method `passes`.

    The sets to compare with a stand behind it in a sorted partition, which is
    read as a stream; each PER_LEADER of them, dealt by hash, have a copy of a of
    their own. So one task holds two sets at a time.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_LEADER).alias("salts"))
    sets = sets.select("rep", "n", what)
    leaders = salts.join(sets.withColumnRenamed("rep", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "n", what)
    members = pairs.join(sets.withColumnRenamed("rep", "b"), "b").join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b", "n", what)
    rows = leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        own = None
        for batch in batches:
            links = []
            for a, b, n, x in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["n"].to_pylist(), batch[what]):
                other = read(n, x.as_py())
                if b is None:
                    own = other
                elif own.passes(other, similarity):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return written(rows.mapInArrow(run, "a long, b long"))


class Outline:
    """A set by its size and bitmap: `passes` says no only where sets are not similar."""

    def __init__(self, n: int, bits: bytes):
        self.n, self.bits = n, np.frombuffer(bits, np.uint8)

    def passes(self, other: Outline, similarity: int) -> bool:
        return similar((self.n + other.n - int(apart(self.bits, other.bits))) // 2, self.n, other.n, similarity)


class Whole:
    """A set by its text."""

    def __init__(self, text: str, n: int):
        self.set = shingles(text, n)

    def passes(self, other: Whole, similarity: int) -> bool:
        both = len(np.intersect1d(self.set, other.set, assume_unique=True))
        return similar(both, len(self.set), len(other.set), similarity)


def verified(pairs: DataFrame, sets: DataFrame, n: int, similarity: int) -> DataFrame:
    """The pairs (a, b) that are linked: those that pass by bitmap are compared by their texts."""
    pairs = written(pairs.where("a <> b").distinct())
    likely = streamed(pairs, sets, "bits", Outline, similarity)
    return streamed(likely, sets, "text", lambda _, text: Whole(text, n), similarity)


def block_pairs(spots: DataFrame, members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """a, b: all pairs of sets with different labels whose groups share a token at places that allow the similarity and whose bitmaps allow it.

    spots: token, group_id, size, place; members: group_id, rep, label. Only
    tokens with several labels are looked at. The sets of a token are dealt into
    blocks of BLOCK, and each two blocks meet in a task that compares them with
    arrays, so what is written are pairs that pass. Blocks of a token's most
    frequent label do not meet each other.
    """
    rows = written(spots.join(members, "group_id").select("token", "group_id", "size", "place", "rep", "label"), large=True)
    labels = rows.groupBy("token", "label").agg(F.count("*").alias("n"))
    tokens = labels.groupBy("token").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda c: F.ceil(c / BLOCK)
    tops, rest = blocks(F.col("top.n")), blocks(F.col("all") - F.col("top.n"))
    # few sets are one block; else the top label's blocks come first
    tokens = tokens.select("token", "all", F.when(F.col("all") <= BLOCK, 0).otherwise(tops).alias("tops"), F.when(F.col("all") <= BLOCK, 1).otherwise(rest).alias("rest"), F.col("top.label").alias("top"))
    dealt = join_classes(rows, written(tokens), "token", "all", rows.count()).withColumn("h", F.xxhash64("rep"))
    is_top = (F.col("tops") > 0) & (F.col("label") == F.col("top"))
    dealt = dealt.withColumn("own", F.when(is_top, F.pmod("h", "tops")).otherwise(F.col("tops") + F.pmod("h", "rest")).cast("int"))
    met = F.sequence(F.when(is_top, F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("rest") - 1)
    dealt = dealt.withColumn("met", F.explode(met)).withColumn("x", F.least("own", "met").cast("int")).withColumn("y", F.greatest("own", "met").cast("int"))
    dealt = dealt.select("token", "x", "y", "own", "group_id", "rep", "label", "size", "place").join(sets.select("rep", "bits"), "rep")
    dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")

    def compare(rows: pa.Table) -> pa.RecordBatch:
        x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
        own, group, rep, label, size, place = (rows[c].to_numpy() for c in ("own", "group_id", "rep", "label", "size", "place"))
        least = lambda i, j: (100 + similarity) * np.minimum((size - place)[i][:, None], (size - place)[j]) >= similarity * (size[i][:, None] + size[j])
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        # pairs of groups first, then those of their members
        _, one, part = np.unique(np.stack([group, label, size, place]), axis=1, return_index=True, return_inverse=True)
        part = part.ravel()
        allowed = least(one, one) & (label[one][:, None] != label[one])
        i, j = np.nonzero(allowed[np.ix_(part[left], part[right])])
        i, j = left[i], right[j]
        if x == y:
            i, j = i[i < j], j[i < j]
        bits = rows["bits"].to_pylist()
        width = np.array([len(b) for b in bits])
        found = []
        for k in np.unique(width):
            for m in np.unique(width):
                at = np.flatnonzero((width[i] == k) & (width[j] == m))
                for at in np.array_split(at, len(at) * int(max(k, m)) // (1 << 24) + 1):
                    if len(at):
                        p, q = (np.frombuffer(b"".join(bits[r] for r in z), np.uint8).reshape(len(at), -1) for z in (i[at], j[at]))
                        a, b = size[i[at]].astype(np.int64), size[j[at]].astype(np.int64)
                        ok = similar((a + b - apart(p, q)) // 2, a, b, similarity)
                        found.append((rep[i[at][ok]], rep[j[at][ok]]))
        a, b = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held, key = [], None
        for b in batches:
            keys = np.stack([b[c].to_numpy() for c in ("token", "x", "y")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, b.num_rows]):
                if lo == hi:
                    continue
                now = tuple(keys[:, lo])
                if now != key and held:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(b.slice(lo, hi - lo))
        if held:
            yield compare(pa.Table.from_batches(held))

    return written(dealt.mapInArrow(run, "a long, b long"), large=True).distinct()


def jaccard_join(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Documents are linked if 100 |A and B| >= similarity |A or B| for their sets
    of n-word shingles of lower-cased words; a document of fewer words has them
    all as its one shingle, one without words (or null) is linked with nothing.
    component_id is the smallest doc_id that links lead to. Rows that repeat a
    doc_id are documents of their own, which share the id in the result; null
    ids come first. An empty table gives no rows.

    Equal sets are one class. Classes of one size and prefix form a group; groups
    that share a prefix token at places that allow the similarity are candidates.
    Each round compares the groups of a token with one of them, its leader, which
    joins large families of copies by few links; groups already in one component
    are not compared, and a leader compared with all others leaves the token.
    What is left of tokens with several components then is compared by blocks,
    all pairs of sets in different components, so that no link between components
    is lost. Bitmaps of the sets rule most pairs out before texts are read.
    """
    rows, back = identified(docs)
    return own_ids(joined(rows, n, similarity), back, "doc_id", "component_id")


def first_of_each(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """One row of each component that jaccard_join finds, the first by (doc_id, hash of the text), with all columns of docs. It is chosen by row, so rows that share a doc_id or have none are told apart."""
    rows, _ = identified(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")), "_row")
    gone = joined(rows.select("doc_id", "text"), n, similarity).where("doc_id <> component_id").select("doc_id")
    return rows.join(gone, "doc_id", "left_anti").select("_row.*")


def joined(rows: DataFrame, n: int, similarity: int) -> DataFrame:
    """doc_id, n_shingles, component_id as jaccard_join has them, for rows whose doc_id are different and not null."""
    seen = written(measured(rows, n))
    found = seen.where("n IS NOT NULL").select("doc_id", "n", F.struct("d1", "d2").alias("set"))
    classes = written(found.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")))
    known = seen.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= COMMON)
    known = known.orderBy(F.desc("count"), "token").limit(KNOWN).collect()
    kept = written(shared_prefixes(prefixes(rows, n, similarity, known)), large=True)
    spots = kept.where("place IS NOT NULL").select("token", "group_id", "size", "place").distinct()
    groups = kept.where("place IS NULL").select("group_id", "size", F.struct("d1", "d2").alias("set")).distinct().join(classes, "set").select("group_id", "size", "rep")
    per_group = groups.groupBy("group_id").agg(F.min("rep").alias("first"), F.count("*").alias("sets"))
    # groups that have a candidate, within or beside them
    in_tokens = spots.select("group_id").distinct().withColumn("shared", F.lit(1))
    groups = written(groups.join(per_group.join(in_tokens, "group_id", "left").where("shared = 1 OR sets > 1").drop("shared"), "group_id"))
    # dealt by id before the join, so that the rounds can join the table without moving texts
    by_id = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    sets, name = bucketed(described(by_id.join(groups.select(F.col("rep").alias("doc_id")).distinct(), "doc_id"), n), "rep")

    parts = groups.where("rep = first").select("group_id", "sets", "rep", F.col("rep").alias("label"))
    inside = groups.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    links = None
    for k in range(ROUNDS):
        live = written(spots.join(parts, "group_id"))
        at = F.struct("rep", "label", "size", "place")
        lead = live.groupBy("token").agg(F.min(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), at.alias("at")))["at"].alias("x"), F.min("label").alias("m"), F.max("label").alias("o"), F.max("sets").alias("most"), F.count("*").alias("spots"))
        lead = written(lead.where("m <> o").select("token", "x", "most", "spots"))
        live = written(join_classes(live, lead, "token", "spots", live.count()).select("token", "group_id", "x", "most", at.alias("y")))
        met = live.where(F.col("x.label") != F.col("y.label")).where(possible("x", "y", similarity)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        more = verified(met.unionByName(inside) if k == 0 else met, sets, n, similarity)
        spots = live.where("x.rep <> y.rep OR most > 1").select("token", "group_id", F.col("y.size").alias("size"), F.col("y.place").alias("place")).distinct()
        done = k > 0 and more.isEmpty()
        links = more if links is None else links.unionByName(more)
        if not done:
            label = components(links).select(F.col("node").alias("rep"), F.col("component"))
            labels = written(groups.join(label, "rep", "left").withColumn("label", F.coalesce("component", "rep")))
            parts = labels.groupBy("group_id", "label").agg(F.min("rep").alias("rep"), F.max("sets").alias("sets"))
        if done:
            break

    members = labels.select("group_id", "rep", "label")
    within = labels.where("sets > 1").select(F.col("group_id").alias("token"), "group_id", "size", F.lit(0).alias("place")).distinct()
    links = links.unionByName(verified(block_pairs(spots.unionByName(within), members, sets, similarity), sets, n, similarity))

    label = components(links).withColumnRenamed("node", "rep")
    classes = written(classes.join(label, "rep", "left").select("set", "members", F.coalesce("component", "rep").alias("component_id")))
    rows.sparkSession.sql(f"DROP TABLE {name}")
    out = join_classes(found.where("n > 0"), classes, "set", "members", found.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
