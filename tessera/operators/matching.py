"""Which files belong together: sidecars and media, stills and clips, sources and outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import values as V
from tessera.functions import paths
from tessera.operators.lineage import settle, spread_out

STRATEGIES = (
    "direct_match", "same_name", "case_insensitive", "xmp_metadata", "document_id", "fuzzy_match", "xmp_ref_scan", "partial_match", "subdirectory",
)


def _joined(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of which both sides grow with the library: by shuffle and sort. From the files' packed sizes Spark would take a side for small and pass it whole through the driver."""
    return left.join(right.hint("merge"), on, how)


def _keyed_sidecars(sidecars: DataFrame) -> DataFrame:
    path = F.col("xmp_path")
    return sidecars.withColumns({
        "x_dir": paths.directory(path), "x_name": paths.name(path), "x_stem": paths.stem(path),
    }).withColumns({
        "x_low": F.lower("x_stem"), "x_root": F.substring_index(F.lower("x_stem"), ".", 1),
        "x_plain": paths.letters_and_digits(F.col("x_stem")), "x_plain_root": paths.letters_and_digits(F.substring_index("x_stem", ".", 1)),
    })


def _keyed_media(media: DataFrame) -> DataFrame:
    path = F.col("path")
    return media.withColumns({
        "m_dir": paths.directory(path), "m_stem": paths.stem(path), "m_media": paths.is_potential_media(path),
    }).withColumns({
        "m_low": F.lower("m_stem"), "m_root": F.substring_index(F.lower("m_stem"), ".", 1),
        "m_plain": paths.letters_and_digits(F.col("m_stem")), "m_plain_root": paths.letters_and_digits(F.substring_index("m_stem", ".", 1)),
    })


def sidecar_candidates(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """xmp_path, path, rank (of the strategy), rest: the least path that each strategy finds for a sidecar.

    ``sidecars`` has xmp_path, document_id, derived_from, source; ``media`` path,
    document_id, xmp_ref. Every strategy is an equi join on derived keys; media
    are reduced to the least path of each key first, so that a name that many
    files share makes no pairs. Where names are compared by containment, the keys are
    pieces that any contained name must have, and the comparison follows.
    """
    s, m = _keyed_sidecars(sidecars), _keyed_media(media)
    return _by_names(s, m).unionByName(_by_pieces(s, m))


def _equal(s: DataFrame, among: DataFrame, rank: int, left: Column, right: Column, rest: int = 0, directory: bool = True) -> DataFrame:
    """Candidates whose keys are equal, in one directory or anywhere."""
    key = F.struct(F.col("m_dir") if directory else F.lit(""), right)
    least = among.filter(right.isNotNull() & (right != "")).groupBy(key.alias("_m")).agg(F.min("path").alias("path"))
    keyed = s.filter(left != "").withColumn("_s", F.struct(F.col("x_dir") if directory else F.lit(""), left))
    found = _joined(keyed, least, F.col("_s") == F.col("_m")).select("xmp_path", "path", F.lit(rank).alias("rank"), F.lit(rest).alias("rest"))
    return found.filter("path <> xmp_path")


def _by_names(s: DataFrame, m: DataFrame) -> DataFrame:
    """Candidates of the strategies that compare whole names, 0 to 5."""
    usable = m.filter("m_media")
    inside = lambda child: F.concat(F.col("x_dir"), F.lit("/"), child)
    bare = F.when(F.lower(F.col("xmp_path")).endswith(".xmp"), F.expr("left(xmp_path, char_length(xmp_path) - 4)"))
    return _union([
        _equal(s, m, 0, bare, F.col("path"), directory=False),
        _equal(s, usable, 1, F.col("x_low"), F.col("m_low")), _equal(s, usable, 1, F.col("x_root"), F.col("m_root")), _equal(s, usable, 2, F.col("x_low"), F.col("m_low")),
        _equal(s, m, 3, F.when(~F.contains("derived_from", F.lit("uuid:")), inside(F.col("derived_from"))), F.col("path"), directory=False),
        _equal(s, m, 3, inside(F.col("source")), F.col("path"), rest=1, directory=False),
        _equal(s, usable, 4, F.when(paths.is_uuid_name(F.col("x_stem")), F.col("document_id")), F.trim("document_id")),
        _equal(s, usable, 5, F.col("x_plain"), F.col("m_plain")), _equal(s, usable, 5, F.when(F.col("x_plain") != "", F.col("x_plain_root")), F.col("m_plain_root")),
    ])


def _by_pieces(s: DataFrame, m: DataFrame) -> DataFrame:
    """Candidates of the strategies that look into names or upwards, 6 to 8. Names are cut into pieces only in directories that have a sidecar of ``s``."""
    usable = m.filter("m_media")
    beside = spread_out(_joined(usable, s.select(F.col("x_dir").alias("m_dir")).distinct(), "m_dir", "left_semi"), "path")
    parents = usable.withColumn("_up", F.explode(F.array_distinct(F.array("m_dir", paths.directory(F.col("m_dir")))))).drop("m_dir").withColumnRenamed("_up", "m_dir")
    tagged = _equal(s, _named_in_tags(beside), 6, F.col("x_name"), F.col("_piece"))
    return _union([tagged, _partial(s, beside), _equal(s, parents, 8, F.col("x_low"), F.col("m_low"))])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _named_in_tags(media: DataFrame) -> DataFrame:
    """Media with each piece of its tag text that ends in .xmp and may be a file name."""
    ends = media.filter(F.lower("xmp_ref").contains(".xmp")).withColumn("_end", F.explode(F.sequence(F.lit(1), F.char_length("xmp_ref") - 3)))
    ends = ends.filter(F.lower(F.substr("xmp_ref", F.col("_end"), F.lit(4))) == ".xmp")
    starts = ends.withColumn("_start", F.explode(F.sequence(F.greatest(F.col("_end") - 251, F.lit(1)), "_end")))
    return starts.withColumn("_piece", F.substr("xmp_ref", F.col("_start"), F.col("_end") + 4 - F.col("_start")))


def _held_stems(stem: str) -> Column:
    """Every piece of a stem that has 70 percent of its bytes at least, itself included: as many as the square of what may be missing, whatever the other names are."""
    missing = F.floor(F.octet_length(stem) * 0.3).cast("int")
    cuts = F.sequence(F.lit(0), missing)
    piece = lambda a, b: F.substr(F.col(stem), a + 1, F.greatest(F.char_length(stem) - a - b, F.lit(0)))
    pieces = F.flatten(F.transform(cuts, lambda a: F.transform(F.sequence(F.lit(0), missing - a), lambda b: piece(a, b))))
    return F.array_distinct(F.filter(pieces, lambda p: (p != "") & (F.floor(F.octet_length(p) * 100 / F.octet_length(stem)) >= 70)))


def _partial(s: DataFrame, usable: DataFrame) -> DataFrame:
    """Either stem holds the other, which has 70 percent of its bytes at least; sidecar stems have four bytes at least.

    The longer stem's pieces of that length are the keys, and media are reduced to the least path of each key before the
    join, so a beginning that many names share makes no pairs.
    """
    x, m = s.filter(F.octet_length("x_stem") >= 4), usable.filter("m_stem <> ''")
    found = []
    for mine, theirs in ((F.array("x_stem"), _held_stems("m_stem")), (_held_stems("x_stem"), F.array("m_stem"))):
        least = m.select("path", F.col("m_dir").alias("x_dir"), F.explode(theirs).alias("_k")).groupBy("x_dir", "_k").agg(F.min("path").alias("path"))
        keyed = x.select("xmp_path", "x_dir", F.explode(mine).alias("_k"))
        found.append(_joined(keyed, least, ["x_dir", "_k"]).groupBy("xmp_path").agg(F.min("path").alias("path")))
    return _union(found).select("xmp_path", "path", F.lit(7).alias("rank"), F.lit(0).alias("rest"))


def sidecar_cascade(sidecars: DataFrame, media: DataFrame) -> DataFrame:
    """xmp_path, media_path, strategy: what the first strategy that finds anything finds, the least path first; no_match for none.

    What whole names tell is settled first; names are cut into pieces only for the sidecars that are left, and only beside them.
    """
    s, m = _keyed_sidecars(sidecars), _keyed_media(media)
    first = lambda found: found.groupBy("xmp_path").agg(F.min(F.struct("rank", "rest", "path")).alias("best"))
    named_alike = settle(first(_by_names(s, m)))
    left = settle(_joined(s, named_alike, "xmp_path", "left_anti"))
    best = named_alike.unionByName(first(_by_pieces(left, m)))
    named = F.get(F.array(*[F.lit(x) for x in STRATEGIES]), F.col("best.rank"))
    return _joined(sidecars.select("xmp_path"), best, "xmp_path", "left").select(
        "xmp_path", F.col("best.path").alias("media_path"), F.coalesce(named, F.lit("no_match")).alias("strategy")
    )


def existing_sidecar(files: DataFrame, present: DataFrame) -> DataFrame:
    """path, sidecar: the first of path.xmp, path.XMP and stem.xmp that is there, else null."""
    stem = F.concat(paths.directory(F.col("path")), F.lit("/"), paths.stem(F.col("path")), F.lit(".xmp"))
    wanted = F.array(F.concat("path", F.lit(".xmp")), F.concat("path", F.lit(".XMP")), stem)
    tried = files.select("path", F.posexplode(wanted).alias("rank", "sidecar"))
    found = _joined(tried, present.select(F.col("path").alias("sidecar")).distinct(), "sidecar")
    first = found.groupBy("path").agg(F.min(F.struct("rank", "sidecar")).alias("best"))
    return _joined(files.select("path"), first, "path", "left").select("path", F.col("best.sidecar").alias("sidecar"))


def live_photos(files: DataFrame) -> DataFrame:
    """Files that are half of a live photo: a still with a clip of the same stem beside it, or the reverse."""
    key = files.withColumns({"_dir": paths.directory(F.col("path")), "_stem": paths.stem(F.col("path")), "_ext": F.regexp_extract("path", r"\.([^./]*)$", 1)})
    clips = key.filter(F.col("_ext").isin("mov", "MOV")).select("_dir", "_stem")
    stills = key.filter(F.col("_ext").isin(V.LIVE_STILL_COMPANIONS)).select("_dir", "_stem")
    of = lambda exts: key.filter(F.lower("_ext").isin(exts))
    pairs = _joined(of(V.LIVE_STILLS), clips, ["_dir", "_stem"], "left_semi").unionByName(_joined(of(["mov"]), stills, ["_dir", "_stem"], "left_semi"))
    return pairs.select(*files.columns)


def paired_trees(sources: DataFrame, outputs: DataFrame, source_root: str, output_root: str) -> DataFrame:
    """source_path, output_path of files with the same path below their roots."""
    left = sources.select(F.col("path").alias("source_path"), paths.relative(F.col("path"), source_root).alias("relative"))
    right = outputs.select(F.col("path").alias("output_path"), paths.relative(F.col("path"), output_root).alias("relative"))
    return _joined(left, right, "relative").select("source_path", "output_path")


def timestamp_sources(outputs: DataFrame, sources: DataFrame, output_root: str, source_root: str) -> DataFrame:
    """output_path, source_path: the source of the same stem and directory, by the fixed order of extensions."""
    order = {e: i for i, e in enumerate(V.TIMESTAMP_EXTENSIONS)}
    rank = F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.regexp_extract("path", r"\.([^./]*)$", 1))
    keyed = lambda df, root: df.withColumn("_rel", paths.relative(F.col("path"), root)).filter("_rel is not null").withColumns(
        {"_dir": paths.directory(F.col("_rel")), "_stem": paths.stem(F.col("_rel"))}
    )
    left = keyed(outputs, output_root).filter("_stem <> ''").select(F.col("path").alias("output_path"), "_dir", "_stem")
    right = keyed(sources, source_root).withColumn("_rank", rank).filter("_rank is not null").select("_dir", "_stem", "_rank", F.col("path").alias("source_path"))
    best = right.groupBy("_dir", "_stem").agg(F.min(F.struct("_rank", "source_path")).alias("best"))
    return _joined(left, best, ["_dir", "_stem"]).select("output_path", F.col("best.source_path").alias("source_path"))


def merge_summary(matches: DataFrame, succeeded: Column) -> DataFrame:
    """strategy, sidecars, merged, failed, skipped: skipped have no media, failed have but weren't merged."""
    matched = F.col("media_path").isNotNull()
    return matches.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("sidecars"), F.count_if(matched & succeeded).alias("merged"), F.count_if(matched & ~succeeded).alias("failed"),
        F.count_if(~matched).alias("skipped"),
    )


def metadata_sidecar(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """path, sidecar of each file: stem.ext.xmp, else stem.xmp, else the least sidecar beside it of the same stem, name or root stem in any case."""
    path = F.col("path")
    f = files.select("path", paths.directory(path).alias("_dir"), paths.stem(path).alias("_stem"), F.regexp_extract(paths.name(path), r".\.([^.]*)$", 1).alias("_ext")).withColumns({
        "_low": F.lower("_stem"), "_root": F.substring_index(F.lower("_stem"), ".", 1),
    })
    beside = sidecars.filter(F.lower(paths.extension(F.col("xmp_path"))) == "xmp").select(
        "xmp_path", paths.directory(F.col("xmp_path")).alias("_xd"), F.lower(paths.stem(F.col("xmp_path"))).alias("_xs")
    )
    joined = []

    def equal(rank: int, left: Column, right: Column, directory: bool) -> None:
        least = beside.groupBy((F.col("_xd") if directory else F.lit("")).alias("_kd"), right.alias("_k")).agg(F.min("xmp_path").alias("sidecar"))
        mine = f.select("path", (F.col("_dir") if directory else F.lit("")).alias("_kd"), left.alias("_k"))
        joined.append(_joined(mine, least, ["_kd", "_k"]).select("path", F.lit(rank).alias("rank"), "sidecar"))

    full = F.concat("_dir", F.lit("/"), "_stem", F.when(F.col("_ext") != "", F.concat(F.lit("."), "_ext")).otherwise(""), F.lit(".xmp"))
    equal(0, F.when(F.col("_ext") != "", full), F.col("xmp_path"), False)
    equal(1, F.concat("_dir", F.lit("/"), "_stem", F.lit(".xmp")), F.col("xmp_path"), False)
    equal(2, F.col("_low"), F.col("_xs"), True)
    equal(2, F.concat("_low", F.lit("."), "_ext"), F.col("_xs"), True)
    equal(2, F.col("_root"), F.substring_index("_xs", ".", 1), True)
    best = _union(joined).groupBy("path").agg(F.min(F.struct("rank", "sidecar")).alias("_b"))
    return _joined(files.select("path"), best, "path", "left").select("path", F.col("_b.sidecar").alias("sidecar"))
