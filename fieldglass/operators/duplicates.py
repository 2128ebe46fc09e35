"""Exact duplicates, Hamming range joins, fingerprints, tree comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.operators.ordering import ordinals
from fieldglass.plans.scratch import stage


def _numbered(groups: DataFrame, key: str) -> DataFrame:
    """Groups with their 1-based number in the key's order, without a window over all of them."""
    return ordinals(groups, [], [F.asc(key)], "group_id")


def exact_groups(rows: DataFrame, digest: Column, split: str, id_col: str, candidate: str | None = None) -> DataFrame:
    """Groups of equal content, numbered by digest, with their class.

    cross_split if a candidate has the content in several splits, else
    within_split if one has it twice, else cross_candidate; ``cross_candidate``
    also tells on its own whether several candidates have it.
    """
    own = F.col(candidate) if candidate else F.lit("")
    per = rows.groupBy(digest.alias("digest"), own.alias("c")).agg(F.count("*").alias("n"), F.count_distinct(split).alias("splits"), F.min(id_col).alias("first_id"))
    g = per.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("splits").alias("splits"), F.max("n").alias("most"), F.count("*").alias("candidates"), F.min("first_id").alias("first_id")).where("group_size > 1")
    kind = F.when(F.col("splits") > 1, "cross_split").when(F.col("most") > 1, "within_split").otherwise("cross_candidate")
    out = _numbered(g, "digest").select("group_id", "digest", "group_size", kind.alias("group_class"), "first_id", *([(F.col("candidates") > 1).alias("cross_candidate")] if candidate else []))
    return out


def source_groups(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Sources of several rows, numbered by key: group_id, key, group_size, cross_split."""
    g = rows.groupBy(key).agg(F.count("*").alias("group_size"), (F.count_distinct(split) > 1).alias("cross_split")).where("group_size > 1")
    return _numbered(g, key)


def candidate_pairs(rows: DataFrame, id_col: str, key: str, near: DataFrame) -> DataFrame:
    """first_id, second_id, reasons: pairs that share a source, and near pairs (first_id, second_id)."""
    a, b = rows.alias("a"), rows.alias("b")
    same = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))).select(F.col(f"a.{id_col}").alias("first_id"), F.col(f"b.{id_col}").alias("second_id"), F.lit("shared_source_name").alias("reason"))
    close = near.select(F.least("first_id", "second_id").alias("first_id"), F.greatest("first_id", "second_id").alias("second_id"), F.lit("near_hash").alias("reason"))
    return same.unionByName(close).groupBy("first_id", "second_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def first_pairs(pairs: DataFrame, most: int = 50_000) -> tuple[DataFrame, bool]:
    """(the first pairs in order, whether there were more)."""
    rows = pairs.orderBy("first_id", "second_id").limit(most + 1)
    return rows.limit(most), rows.count() > most


def hamming_pairs(rows: DataFrame, id_col: str, bits_col: str, width: int, most: int) -> DataFrame:
    """first_id, second_id, distance for all pairs within ``most`` bits.

    most + 1 disjoint bands: of so many, one at least is equal (pigeonhole).
    A pair is made in its first equal band alone, so nothing is made twice.
    """
    n = most + 1
    cut = [width * k // n for k in range(n + 1)]
    band = lambda c, k: F.shiftright(c, cut[k]).bitwiseAND(F.lit((1 << (cut[k + 1] - cut[k])) - 1))
    b = F.col("bits")
    keyed = rows.select(F.col(id_col).alias("id"), F.col(bits_col).cast("long").alias("bits")).select("id", "bits", F.posexplode(F.array(*[band(b, k) for k in range(n)])).alias("k", "value"))
    x, y = keyed.alias("x"), keyed.alias("y")
    diff = F.col("x.bits").bitwiseXOR(F.col("y.bits"))
    earlier = F.lit(False)
    for k in range(n):
        earlier = earlier | ((F.col("x.k") > k) & (band(diff, k) == 0))
    near = F.bit_count(diff) <= most
    return x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.id") < F.col("y.id")) & near & ~earlier).select(
        F.col("x.id").alias("first_id"), F.col("y.id").alias("second_id"), F.bit_count(diff).cast("long").alias("distance")
    )


#: Codes of a bucket that are compared at once.
HOT = 4096


def _bits_of(c: Column, positions: list[int]) -> Column:
    """The bits at these positions, put together."""
    out = F.lit(0).cast("long")
    for at, p in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(c, p).bitwiseAND(F.lit(1)), at))
    return out


def balanced_bands(codes: DataFrame, bits: str, width: int, bands: int) -> list[list[int]]:
    """Positions of each band, so that the bands tell codes apart about equally well.

    A bit that is the same in almost all codes tells nothing; the bits are dealt
    by their entropy, the largest first, each to the band that has least.
    """
    one = codes.agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned(F.col(bits), p).bitwiseAND(F.lit(1))).alias(f"b{p}") for p in range(width)]).first()
    share = lambda p: (one[f"b{p}"] or 0) / max(1, one["n"])
    entropy = {p: -sum(x * math.log2(x) for x in (share(p), 1 - share(p)) if x > 0) for p in range(width)}
    out: list[list[int]] = [[] for _ in range(bands)]
    for p in sorted(range(width), key=lambda p: (-entropy[p], p)):
        min(out, key=lambda b: (sum(entropy[q] for q in b), len(b))).append(p)
    return [sorted(b) for b in out]


def _shared(keyed: DataFrame, by: list[str]) -> DataFrame:
    """Rows of buckets that several share, with the bucket's size ``m``; the sizes are written, so a hot bucket's join can be split."""
    sizes = stage(keyed.groupBy(*by).agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    return keyed.join(sizes, by)


def near_codes(codes: DataFrame, bits: str, width: int, most: int) -> DataFrame:
    """a, b, distance of all pairs of distinct codes a < b within ``most`` bits; codes are distinct longs.

    most + 1 bands: of so many, one at least is equal (pigeonhole), and a pair
    is made in its first equal band alone.  The codes of a band's bucket of more than
    ``HOT`` differ by as little in the other bits, so they are told apart
    by bands of these again; what is still larger is cut into chunks that meet
    in pairs, so no task compares more than two chunks at once.
    """
    n = most + 1
    own = stage(codes.select(F.col(bits).alias("code")), "codes")
    bands = balanced_bands(own, "code", width, n)
    first = own.select("code", F.posexplode(F.array(*[_bits_of(F.col("code"), b) for b in bands])).alias("k", "value"))
    shared = stage(_shared(first, ["k", "value"]), "banded")
    diff = F.col("x.code").bitwiseXOR(F.col("y.code"))
    equal = lambda positions: _bits_of(diff, positions) == 0
    earlier = F.lit(False)
    for k in range(n):
        earlier = earlier | ((F.col("x.k") > k) & equal(bands[k]))
    near = (F.col("x.code") < F.col("y.code")) & (F.bit_count(diff) <= most) & ~earlier
    cold = shared.where(F.col("m") <= HOT)
    pairs = cold.alias("x").join(cold.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.value") == F.col("y.value")) & near)
    cols = [F.col("x.code").alias("a"), F.col("y.code").alias("b"), F.bit_count(diff).cast("long").alias("distance")]
    found = pairs.select(*cols)
    hot = shared.where(F.col("m") > HOT)
    # bands of the other bits, for each first band
    rest = {k: [[p for j, b in enumerate(bands) if j != k for p in b][i::n] for i in range(n)] for k in range(n)}
    below = F.when(F.lit(False), F.array(*[F.lit(0).cast("long")] * n))
    for k in range(n):
        below = below.when(F.col("k") == k, F.array(*[_bits_of(F.col("code"), r) for r in rest[k]]))
    second = hot.select("code", "k", "value", F.posexplode(below).alias("j", "sub"))
    again = _shared(second, ["k", "value", "j", "sub"])
    chunks = F.ceil(F.col("m") / HOT).cast("int")
    cut = again.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))
    cut = stage(cut, "chunks")
    key = ["k", "value", "j", "sub"]
    left = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    x, y = left.alias("x"), left.withColumnRenamed("chunk", "mine").withColumnRenamed("other", "chunk").withColumnRenamed("mine", "other").alias("y")
    sooner = F.lit(False)
    for k in range(n):
        for j in range(n):
            sooner = sooner | ((F.col("x.k") == k) & (F.col("x.j") > j) & equal(rest[k][j]))
    on = (F.col("x.chunk") == F.col("y.chunk")) & (F.col("x.other") == F.col("y.other"))
    for c in key:
        on = on & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return found.unionByName(x.join(y, on & near & ~sooner).select(*cols))


def _partners(rows: DataFrame, id_col: str, bits: str, digest: str, width: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows as id, code, dg; pairs of codes in both directions and of each code with itself)."""
    own = stage(rows.select(F.col(id_col).alias("id"), F.col(bits).cast("long").alias("code"), F.col(digest).alias("dg")).where("id is not null and code is not null"), "signed")
    codes = own.select("code").distinct()
    near = near_codes(codes, "code", width, most)
    # a code is a pair with itself if rows of it have several digests
    several = own.groupBy("code").agg(F.min("dg").alias("p"), F.max("dg").alias("q")).where("p <> q").select(F.col("code").alias("a"), F.col("code").alias("b"), F.lit(0).cast("long").alias("distance"))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(several)
    return own, stage(both, "near-codes")


def _expanded(firsts: DataFrame, own: DataFrame, codes: DataFrame) -> DataFrame:
    """first_id, second_id, distance: ``firsts`` (id, code, dg) with the later rows of other digests in the codes near theirs."""
    x = firsts.select(F.col("id").alias("first_id"), F.col("code").alias("a"), F.col("dg").alias("da")).join(codes, "a")
    y = own.select(F.col("id").alias("second_id"), F.col("code").alias("b"), F.col("dg").alias("db"))
    return x.join(y, "b").where((F.col("first_id") < F.col("second_id")) & (F.col("da") != F.col("db"))).select("first_id", "second_id", "distance")


def near_pairs(rows: DataFrame, id_col: str, bits: str, digest: str, width: int, most: int) -> DataFrame:
    """first_id, second_id, distance of all pairs of rows within ``most`` bits whose digests differ; the earlier row is the first.

    Equal codes are searched once.  Rows without identifier, code or digest take no part.
    """
    own, codes = _partners(rows.where(F.col(digest).isNotNull()), id_col, bits, digest, width, most)
    return _expanded(own, own, codes)


def first_near_pairs(rows: DataFrame, id_col: str, bits: str, digest: str, width: int, most: int, limit: int = 50_000) -> tuple[DataFrame, bool]:
    """(the first ``limit`` pairs of ``near_pairs`` by their rows, whether there were more).

    Rows that have a partner are taken in order, more each time, until they
    give enough pairs: a code that most rows share is never expanded into all of its pairs.
    """
    own, codes = _partners(rows.where(F.col(digest).isNotNull()), id_col, bits, digest, width, most)
    able = stage(own.join(codes.select(F.col("a").alias("code")).distinct(), "code", "left_semi"), "able")
    last, step, out, found = None, 64, None, 0
    while found <= limit:
        left = able if last is None else able.where(F.col("id") > last)
        some = left.select("id").distinct().orderBy("id").limit(step)
        top = some.agg(F.max("id")).first()[0]
        if top is None:
            break
        part = stage(_expanded(left.where(F.col("id") <= top), own, codes).orderBy("first_id", "second_id").limit(limit + 1), "first-pairs")
        found += part.count()
        out = part if out is None else out.unionByName(part)
        last, step = top, step * 4
    if out is None:
        out = _expanded(own, own, codes).limit(0)
    return out.orderBy("first_id", "second_id").limit(limit), found > limit


def fingerprint(rows: DataFrame, by: list[str], path: Column, digest: Column) -> DataFrame:
    """SHA-256 over ``path TAB digest LF`` in the order of (lower path, path), per group."""
    line = F.struct(F.lower(path).alias("l"), path.alias("p"), digest.alias("d"))
    lines = F.array_sort(F.collect_list(line))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x["p"], F.lit("\t"), x["d"], F.lit("\n"))), "")
    return rows.groupBy(*by).agg(F.sha2(text, 256).alias("fingerprint"), F.count("*").alias("files"))


def tree_diff(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row of counts: shared, identical, different, only in one."""
    a, b = first.select(*keys, F.col(value).alias("va"), F.lit(True).alias("ia")), second.select(*keys, F.col(value).alias("vb"), F.lit(True).alias("ib"))
    j = a.join(b, keys, "full_outer")
    both = F.col("ia") & F.col("ib")
    same = F.col("va").eqNullSafe(F.col("vb"))
    return j.agg(
        F.count_if(both).alias("shared"),
        F.count_if(both & same).alias("identical"),
        F.count_if(both & ~same).alias("different"),
        F.count_if(F.col("ib").isNull()).alias("only_first"),
        F.count_if(F.col("ia").isNull()).alias("only_second"),
    )


def pair_files(images: DataFrame, labels: DataFrame, stem: str, by: list[str]) -> DataFrame:
    """Full outer pairing by lower-case stem: paired, image_only, label_only, ambiguous."""
    key = [*by, "stem"]
    side = lambda d, n: d.select(*by, F.lower(F.col(stem)).alias("stem")).groupBy(*key).agg(F.count("*").alias(n))
    j = side(images, "n_images").join(side(labels, "n_labels"), key, "full_outer").na.fill(0, ["n_images", "n_labels"])
    status = F.when((F.col("n_images") == 1) & (F.col("n_labels") == 1), "paired").when((F.col("n_images") > 1) | (F.col("n_labels") > 1), "ambiguous").when(F.col("n_labels") == 0, "image_only").otherwise("label_only")
    return j.withColumn("status", status)
