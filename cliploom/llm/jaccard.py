"""Near duplicates: an exact Jaccard self-join of word-shingle sets by a partition of the universe.

Sizes are cut into bands, so that sets of similarity ``least`` lie in the same band or in neighbouring ones; a slot holds
such pairs, and gives an upper bound H on how many shingles the two may differ in. In a slot the universe of shingle hashes
is cut into m segments. A segment is *exact* (both sides must agree in it: one credit), *one-off* (they may differ by one
shingle, found through one-deletion neighbourhoods: two credits), or skipped (no credit). If credits sum to more than
H, similar sets must meet in one segment. Segments that are empty are useless as a key, so the sum has some slack for
them; a set that needs more than the slack puts out the empty keys as well. A pair is lost only if both sets drop what they
share, and of two sets within the slack neither can.

Allocation goes by cost, measured on a bounded sample of sets: segments in which unrelated sets often agree (those with
shingles of common passages) are skipped, and as many cheap segments become one-off. Any allocation finds all
pairs; the sample only decides how many candidates there are to verify.

Then, without ever listing all pairs of a group of agreeing sets: equal sets are one representative from the start; within each
group all members are compared with the smallest one; what that links is joined into components; only members that are
still in different components of a group are compared further: within bands of size, and if their parity sketches (whose
distance never exceeds the true one) allow it. Sketches are as wide as sets are large, a bit for each shingle at least, so that they
tell unrelated sets of every size apart. Every candidate is verified on the full sets.

Defined results: texts that are null or without words have empty sets and link with nothing; ids that are null are never a
representative unless alone; repeated rows are equal sets; an empty table gives an empty result. Shingles and sets are
compared by 64-bit and 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import free, map_slices, materialize, partitions, tidy
from cliploom.llm.components import components

U = np.uint64
SKETCH = 8  # words of 64 bits


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words (of the whole sequence, if it is shorter)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, U)
    for j in range(k):
        h = mix(h) + w[j : len(w) - k + 1 + j]
    return np.unique(mix(h))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def set_ids(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return signed(d & (2**64 - 1)), signed(d >> 64)


def parity_sketch(s: np.ndarray, words: int = SKETCH) -> list[int]:
    """Which of the bits an odd number of shingles falls on: sets that differ by d shingles differ in d bits at most."""
    bit = np.bincount((mix(s) >> U(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return [int(x) for x in np.packbits(bit.astype(np.uint8), bitorder="little").view(np.int64)]


def wide_sketch(s: np.ndarray) -> list[int] | None:
    """For sets that are too large for ``SKETCH``: a sketch of a power of two words with a bit for each shingle at least."""
    if len(s) <= 64 * SKETCH:
        return None
    return parity_sketch(s, 1 << (-(-len(s) // 64) - 1).bit_length())


class Slots:
    """Bands of sizes, the bound H of each slot and the allocation of its segments."""

    def __init__(self, most: int, percent: int):
        self.percent = percent
        grow = lambda n: n * 100 // percent
        self.high = [0, 1]
        while self.high[-1] < most:
            self.high.append(max(self.high[-1] + 1, grow(self.high[-1])))
        self.high.append(max(self.high[-1] + 1, grow(self.high[-1])))
        self.kind: dict[int, np.ndarray] = {}
        self.slack: dict[int, int] = {}
        self.start: dict[int, int] = {}
        for b in range(1, len(self.high) - 1):
            pair = self.high[b] + grow(self.high[b])
            bound = pair * (100 - percent) // (100 + percent)  # differing shingles of a similar pair
            if not bound:
                continue  # such sets are equal
            least = self.high[b - 1] + 1
            m = bound + 1
            for _ in range(20):  # enough segments for the credits that empty ones usually lose
                mean = least / m
                lost = m * np.exp(-mean) * (1 + 0.1 * (1 + mean))
                m = bound + 1 + int(np.ceil(lost + 3 * np.sqrt(lost)))
                m = min(m, bound + 1 + bound // 2 + 2)
            self.kind[b] = np.zeros(m, np.int8)  # 0 exact, 1 one-off, -1 skipped
            self.slack[b] = m - bound - 1

    def of(self, n: int) -> list[int]:
        """The slots of a set of n shingles: as the smaller side, and as the larger one."""
        b = int(np.searchsorted(self.high, n))
        return [s for s in (b, b - 1) if s in self.kind]

    def segments(self, s: np.ndarray, slot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m = len(self.kind[slot])
        seg = (((s >> U(32)) * U(m)) >> U(32)).astype(np.int64)
        size = np.bincount(seg, minlength=m)
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U)))
        end = np.cumsum(size)
        salt = mix(np.arange(m, dtype=U) + U(slot << 32))
        return seg, size, total[end] - total[end - size], salt

    def keys(self, s: np.ndarray, slot: int) -> np.ndarray:
        """The keys under which a set can be found in a slot."""
        kind = self.kind[slot]
        seg, size, sums, salt = self.segments(s, slot)
        lost = np.where(kind == 0, size == 0, (kind == 1) & (size <= 1))
        needy = (lost * (kind + 1)).sum() > self.slack[slot]
        out = [mix(sums + salt)[(kind >= 0) & ((size > 0) | needy)]]
        if (kind == 1).any():
            off = (kind[seg] == 1) & ((size[seg] > 1) | needy)
            out.append(mix(sums[seg[off]] - mix(s[off] ^ U(0x5851F42D4C957F2D)) + salt[seg[off]]))
        return np.concatenate(out)

    def allocate(self, sets: list[np.ndarray], dear: float = 4.0) -> None:
        """Skip segments where unrelated sets often agree; as many of the cheapest become one-off."""
        by: dict[int, list] = {}
        for s in sets:
            for slot in self.of(len(s)):
                _, size, sums, salt = self.segments(s, slot)
                by.setdefault(slot, []).append(np.where(size > 0, mix(sums + salt), U(0)))
        for slot, rows in by.items():
            keys = np.sort(np.array(rows), axis=0)
            agree = ((keys[1:] == keys[:-1]) & (keys[1:] != 0)).sum(0)
            order = np.argsort(agree, kind="stable")
            n = min(int((agree > dear * (np.median(agree) + 1)).sum()), len(agree) // 20)
            if n:
                self.kind[slot][order[-n:]] = -1
                self.kind[slot][order[:n]] = 1


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _groups(batches, most: int = 512):
    """Of sorted rows (sig, sid): the sets that share a key, one list per key.

    A list that grows beyond ``most`` over the end of a batch is put out in parts, with the key as the group's number.
    """
    schema = pa.schema([("gid", pa.int64()), ("sids", pa.list_(pa.int64()))])

    def lists(gids, parts):
        return pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], schema=schema)

    tail, tail_sig, tail_sid, parted = np.zeros(0, np.int64), None, None, False
    for batch in batches:
        sig = batch.column("sig").to_numpy(zero_copy_only=False)
        sid = batch.column("sid").to_numpy(zero_copy_only=False)
        if not len(sig):
            continue
        again = np.concatenate(([sig[0] == tail_sig and sid[0] == tail_sid], (sig[1:] == sig[:-1]) & (sid[1:] == sid[:-1])))
        sig, sid = sig[~again], sid[~again]
        if not len(sig):
            continue
        gids, parts = [], []
        if tail_sig is not None and sig[0] != tail_sig:  # the waiting group is complete
            if len(tail) > (0 if parted else 1):
                gids.append(int(tail_sig) if parted else None)
                parts.append(tail)
            tail, parted = np.zeros(0, np.int64), False
        sig, sid = np.concatenate((np.full(len(tail), sig[0]), sig)), np.concatenate((tail, sid))
        edge = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
        for k in np.flatnonzero(np.diff(edge)[:-1] > 1).tolist() if len(edge) > 2 else []:
            gids.append(int(sig[edge[k]]) if k == 0 and parted else None)
            parts.append(sid[edge[k] : edge[k + 1]])
        if parted and len(edge) > 2:
            if edge[1] == 1:  # the last row of a group put out in parts
                gids.append(int(sig[0]))
                parts.append(sid[:1])
            parted = False
        tail, tail_sig, tail_sid = sid[edge[-2] :], sig[-1], sid[-1]
        if len(tail) > most:
            gids.append(int(tail_sig))
            parts.append(tail)
            tail, parted = tail[:0], True
        if parts:
            yield lists(gids, parts)
    if tail_sig is not None and len(tail) > (0 if parted else 1):
        yield lists([int(tail_sig) if parted else None], [tail])


def shingle_sets(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, sid, sid2, sketch, wide): size and digests of every row's shingle set."""

    def make():
        def run(texts: list) -> dict:
            out: dict[str, list] = {"n": [], "sid": [], "sid2": [], "sketch": [], "wide": []}
            for t in texts:
                s = shingles(t, k)
                a, b = set_ids(s)
                for name, v in zip(out, (len(s), a, b, parity_sketch(s), wide_sketch(s)), strict=True):
                    out[name].append(v)
            return out

        return run

    return map_slices(docs, text_col, make, "n long, sid long, sid2 long, sketch array<long>, wide array<long>", [id_col])


def _allocation(docs: DataFrame, sets: DataFrame, most: int, k: int, percent: int, id_col: str, text_col: str, sample_sets: int) -> Slots:
    slots = Slots(most, percent)
    n = sets.count()
    bound = min(2**63 - 1, int(-(2**63) + min(1.0, sample_sets / max(n, 1)) * (2**64 - 1)))
    sample = docs.where(F.xxhash64(F.col(id_col).cast("string")) <= bound).select(text_col)

    def make():
        return lambda texts: {"s": [shingles(t, k).tobytes() for t in texts]}

    got = map_slices(sample, text_col, make, "s binary", []).where("octet_length(s) >= 32 and octet_length(s) <= 16000").distinct()
    slots.allocate([np.frombuffer(r["s"], U) for r in got.orderBy(F.xxhash64("s")).limit(sample_sets).collect()])
    return slots


def _sizes(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _apart(x: Column, y: Column) -> Column:
    """Distance of two sketches of as many words."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)


def _folded(x: Column) -> Column:
    """The sketch of half as many words: the same bits, their places modulo the new size."""
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes and sketches allow similarity: the sketches' distance is at most the number of differing shingles."""
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    allowed = lambda distance: distance * (100 + percent) <= (x + y) * (100 - percent)
    # Sets of similar sizes have sketches of the same size or of twice as many words.
    p, q = F.col(f"{a}.wide"), F.col(f"{b}.wide")
    distance = (
        F.when(F.size(p) == F.size(q), _apart(p, q))
        .when(F.size(p) == 2 * F.size(q), _apart(_folded(p), q))
        .when(2 * F.size(p) == F.size(q), _apart(p, _folded(q)))
        .otherwise(0)
    )
    return _sizes(x, y, percent) & allowed(apart) & (p.isNull() | q.isNull() | allowed(distance))


def _band(n: Column, percent: int) -> Column:
    """Bands of sizes: similar sets lie in the same or in neighbouring ones (steps are a trifle wider than the bound)."""
    return F.floor(F.log(n) * ((1 - 1e-6) / float(np.log(100 / percent)))).cast("int")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, listed: int = 2_000_000) -> DataFrame:
    """Pairs (a, b) of representatives whose full sets are similar."""
    texts = docs.select(F.col(id_col).alias("v"), F.col(text_col).alias("_text"))

    def members(of: DataFrame) -> DataFrame:
        ids = materialize(of.select(F.explode(F.array("a", "b")).alias("_v")).distinct(), "candidates")
        few = ids.count() <= listed  # 8 bytes each: at most 16 MB to the tasks
        return texts.join(F.broadcast(ids) if few else ids, texts["v"] == ids["_v"], "left_semi")

    def make():
        return lambda texts: {"s": [shingles(t, k).tobytes() for t in texts]}

    sets = materialize(map_slices(members(pairs), "_text", make, "s binary", ["v"]), "candidate-sets")
    wide = pairs.join(sets.select(F.col("v").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("v").alias("b"), F.col("s").alias("s_b")), "b")

    def check(batches):
        for batch in batches:
            ok = [
                jaccard_at_least(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent)
                for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return wide.select("a", "b", "s_a", "s_b").mapInArrow(tidy(check), f"a {kind}, b {kind}").distinct()


def similar_components(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sample_sets: int = 6_000,
) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that links reach from each row."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    sets = materialize(shingle_sets(docs, k, id_col, text_col), "shingle-sets")
    reps = sets.where("n > 0").groupBy("sid", "sid2").agg(F.min(id_col).alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    reps = materialize(reps, "set-representatives")
    most = reps.agg(F.max("n")).first()[0] or 1
    slots = _allocation(docs, sets, most, k, percent, id_col, text_col, sample_sets)

    def make():
        def run(texts: list) -> dict:
            sids, keys = [], []
            for t in texts:
                s = shingles(t, k)
                own = [slots.keys(s, slot) for slot in slots.of(len(s))]
                sids.append(set_ids(s)[0])
                keys.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
            return {"sid": sids, "keys": keys}

        return run

    rows = map_slices(docs, text_col, make, "sid long, keys array<long>", [], 1_000_000).select(F.explode("keys").alias("sig"), "sid")
    rows = rows.repartition(partitions(spark), "sig").sortWithinPartitions("sig", "sid")
    groups = materialize(rows.mapInArrow(tidy(_groups), "gid long, sids array<long>"), "key-groups")
    # Two similar sets share many keys: the same list counts once.
    small = groups.where("gid IS NULL").groupBy("sids").agg(F.lit(1)).select(F.xxhash64("sids").alias("gid"), "sids")
    member = small.unionByName(groups.where("gid IS NOT NULL")).select("gid", F.explode("sids").alias("sid"))
    member = materialize(member.join(reps.select("sid", "rep", "n"), "sid").select("gid", "rep", "n"), "group-members")
    known = reps.select("rep", F.struct("rep", "n", "sketch", "wide").alias("x"))
    lead = member.groupBy("gid").agg(F.min("rep").alias("lead"), F.min_by("n", "rep").alias("m"))
    first = member.join(lead, "gid").where((F.col("rep") != F.col("lead")) & _sizes(F.col("n"), F.col("m"), percent))
    first = first.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = first.join(known.select(F.col("rep").alias("a"), F.col("x").alias("xa")), "a").join(known.select(F.col("rep").alias("b"), F.col("x").alias("xb")), "b")
    pairs = materialize(pairs.where(_possible("xa", "xb", percent)).select("a", "b"), "leader-pairs")
    links = materialize(_verified(pairs, docs, k, percent, id_col, text_col), "leader-links")
    label = components(links)
    # Groups that still hold several components. Their pairs with the smallest member are settled.
    placed = member.join(label, F.col("rep") == F.col("v"), "left").select("gid", "rep", F.coalesce("c", "rep").alias("c"))
    mixed = placed.groupBy("gid").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("rep").alias("lead"), F.count("*").alias("many"))
    mixed = mixed.where("low <> high AND many > 2").select("gid", "lead")
    placed = placed.join(mixed, "gid").where("rep <> lead").select("gid", "rep", "c")
    placed = materialize(placed.join(known, "rep").select("gid", "x", "c"), "open-groups")
    # The smaller set of a pair meets the larger one in its own band; of equal sizes the smaller representative comes first.
    left = placed.select("gid", _band(F.col("x.n"), percent).alias("band"), F.col("x").alias("xa"), F.col("c").alias("ca"))
    own = _band(F.col("x.n"), percent)
    right = placed.select("gid", F.explode(F.array(own, own - 1)).alias("band"), F.col("x").alias("xb"), F.col("c").alias("cb"))
    ordered = (F.col("xa.n") < F.col("xb.n")) | ((F.col("xa.n") == F.col("xb.n")) & (F.col("xa.rep") < F.col("xb.rep")))
    rest = left.join(right, (left["gid"] == right["gid"]) & (left["band"] == right["band"]) & ordered & (F.col("ca") != F.col("cb")) & _possible("xa", "xb", percent))
    rest = rest.select(F.least("xa.rep", "xb.rep").alias("a"), F.greatest("xa.rep", "xb.rep").alias("b")).distinct()
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "other-pairs")
    if not rest.isEmpty():
        more = materialize(_verified(rest, docs, k, percent, id_col, text_col), "other-links")
        label = components(links.unionByName(more))
    found = sets.join(reps.select("sid", "sid2", "rep"), ["sid", "sid2"], "left").join(label, F.col("rep") == F.col("v"), "left")
    component = F.when(sets["n"] == 0, F.col(id_col)).otherwise(F.coalesce("c", "rep"))
    return found.select(id_col, sets["n"].alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each component; rows with empty sets all stay."""
    found = similar_components(docs, k, percent, id_col, text_col)
    name = free(docs, "_gone")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
