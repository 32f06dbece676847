"""What an acquisition's file name says about its condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What acquisition files carry in their names.
EXTENSIONS = ("tiff", "tif", "tdat", "tmap", "hdf5", "txt", "mat")
PREFIXES = ("DeepLASI_MAT_export_", "DeepLASI_DATA_", "DeepLASI_MAP_", "DeepLASI_MAT_")
SUFFIXES = ("-donc-accc-w", "-donc-accc")
LIGANDS = ("trna", "mrna", "rrna", "trna2", "rna", "dna", "atp", "gtp", "mg", "mgcl2", "ligand")
UNITS = ("pM", "nM", "uM", "µM", "mM", "M")
DYES = ("cy3", "cy5")

_STAMP = r"_(\d{4}-\d{2}-\d{2})_\d{2}-\d{2}(?:-\d{2})?$"
_DAY = r"^(.*?)(?:^|_)(\d{4})(\d{2})(\d{2})(?=_|$)"
_AMOUNT = rf"(?i)^(\d+(?:\.\d+)?)({'|'.join(UNITS)})$"
_REPLICATE = r"(?i)^(\d+)(?:st|nd|rd|th)?[-_]?replicate$"


def parsed_names(df: DataFrame, name: str = "name", with_stem: bool = False) -> DataFrame:
    """Append construct_variant, dye, ligand, ligand_concentration, ligand_concentration_unit, sample_concentration,
    sample_concentration_unit, date, replicate and video_index; what a name doesn't say is empty (amounts: null).

    Extensions, known prefixes and suffixes, a time stamp and a day of eight digits are taken off. Of the words left, "Cy3
    only" (or Cy5) is the dye; numbered replicates are told by their word; an amount after a ligand is the ligand's, any
    other the sample's (the first counts); the last of the words of two to four digits is the video's number; the rest is
    the construct. No name is refused; null is an empty name. Everything stays in the JVM. With ``with_stem`` the column stem follows: the name
    without what was taken off."""
    base = F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"^.*/(?=[^/])|/$", "")
    stem = F.btrim(F.regexp_replace(base, rf"(?i)\.(?:{'|'.join(EXTENSIONS)})", "_"), F.lit("_ "))
    stem = F.regexp_replace(F.regexp_replace(stem, f"^(?:{'|'.join(PREFIXES)})", ""), f"(?:{'|'.join(SUFFIXES)})$", "")
    own = ["__stem", "__date", "__words", "__dye", "__told", "__kinds", "__video"]
    d = df.withColumn("__stem", stem)
    d = d.withColumn("__date", F.regexp_extract("__stem", _STAMP, 1)).withColumn("__stem", F.regexp_replace("__stem", _STAMP, ""))
    day = F.concat_ws("-", *[F.regexp_extract("__stem", _DAY, k) for k in (2, 3, 4)])
    d = d.withColumn("__date", F.when(F.col("__stem").rlike(_DAY), day).otherwise(F.col("__date")))
    d = d.withColumn("__words", F.filter(F.split(F.regexp_replace("__stem", _DAY, "$1_"), r"[_\s]+"), lambda w: w != ""))

    at = lambda k: F.lower(F.get(F.col("__words"), k))
    alone = [f"{x}only" for x in DYES]
    told = F.transform("__words", lambda w, k: F.when(F.lower(w).isin(*DYES) & F.coalesce(at(k + 1) == "only", F.lit(False)), F.struct(k.alias("k"), F.lit(2).alias("n"))).when(F.lower(w).isin(*alone), F.struct(k.alias("k"), F.lit(1).alias("n"))))
    d = d.withColumn("__told", F.get(F.filter(told, lambda s: s.isNotNull()), 0))
    d = d.withColumn("__dye", F.coalesce(F.initcap(F.substring(at(F.col("__told.k")), 1, 3)), F.lit("")))

    def kind(w, k):
        of_dye = F.coalesce((k >= F.col("__told.k")) & (k < F.col("__told.k") + F.col("__told.n")), F.lit(False))
        ours = F.coalesce(at(k - 1).isin(*LIGANDS), F.lit(False))
        held = F.lower(w).isin(*LIGANDS) & F.coalesce(F.get(F.col("__words"), k + 1).rlike(_AMOUNT), F.lit(False))
        what = F.when(of_dye, "dye").when(w.rlike(_REPLICATE), "replicate").when(w.rlike(_AMOUNT), F.when(ours, "ligand amount").otherwise("sample amount")).when(held, "ligand").otherwise("free")
        return F.struct(w.alias("w"), k.alias("k"), what.alias("what"))

    d = d.withColumn("__kinds", F.transform("__words", kind))
    of = lambda what: F.transform(F.filter("__kinds", lambda s: s["what"] == what), lambda s: s["w"])
    last = lambda what: F.try_element_at(of(what), F.lit(-1))
    first = lambda what: F.get(of(what), 0)
    video = F.try_element_at(F.filter("__kinds", lambda s: (s["what"] == "free") & s["w"].rlike(r"^\d{2,4}$")), F.lit(-1))
    d = d.withColumn("__video", video)
    rest = F.filter("__kinds", lambda s: (s["what"] == "free") & ~s["k"].eqNullSafe(F.col("__video.k")))
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda w: F.when(w.isNotNull(), F.regexp_extract(w, _AMOUNT, 1).cast("double"))
    unit = lambda w: text(F.regexp_extract(w, _AMOUNT, 2))
    return d.withColumns({
        "construct_variant": F.concat_ws(" ", F.transform(rest, lambda s: s["w"])), "dye": F.col("__dye"), "ligand": text(last("ligand")),
        "ligand_concentration": number(last("ligand amount")), "ligand_concentration_unit": unit(last("ligand amount")),
        "sample_concentration": number(first("sample amount")), "sample_concentration_unit": unit(first("sample amount")), "date": F.col("__date"),
        "replicate": text(F.regexp_extract(last("replicate"), _REPLICATE, 1)), "video_index": text(F.col("__video.w")), **({"stem": F.btrim(F.regexp_replace("__stem", _DAY, "$1_"), F.lit("_ "))} if with_stem else {}),
    }).drop(*own)
