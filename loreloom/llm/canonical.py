"""Mapping freely typed values to the entries of a reference list, in SQL alone.

Values are cleaned and cut into words and numbers; every distinct word meets the list's words, and
every whole value that stays open meets the list's whole names, in a partition-based pigeonhole join:
a reference string is cut into k+1 segments, so that within k edits at least one of them stands
unchanged, at most k places off, in the typed string. Segments are joined by equality, the built-in
``levenshtein`` verifies, and values without an entry are found by an anti-join.

A value that writes the name or other name of one entry exactly (but for case, marks, look-alike signs and
decoration) is that entry's. Else it fits an entry if each of its words is a different word of the entry's name
or other name, within the edits allowed for its length or cut short before a dot, and its numbers are among the
entry's, no more of them than the entry has. Of the fitting entries those with the fewest edits stay, of these
the ones with no word missing; one entry left is the match.

Defined results: null and blank values have no row; a value that fits no entry, or several alike, maps
to -1; repeated rows each keep their row; an empty list maps everything to -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import UNICODE_SPACE, Scratch, skew_join

# Letters of other scripts that look like Latin ones, and their Latin twins: fixed values.
LOOKALIKES = ("авекмнорстухіјѕґьԁԛԝαβεηικνορτυχ", "abekmhopctyxijsrbdqwabehikvoptux")
# Latin letters with marks and their plain letters: fixed values.
MARKED = ("àáâãäåāăąçćčďđèéêëēėęěğìíîïīįłñńňòóôõöøōőŕřśšşșťţțùúûüūůűųýÿźżž", "aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorrsssstttuuuuuuuuyyzzz")
# Words that may stand before a name without being part of it: fixed values.
LEADING = "the|a|an|my|our|der|die|das|le|la|les|el|los|las|see|re|cf|fw|fwd|siehe|vgl|voir|ver"


def _roman(n: int) -> str:
    return "x" * (n // 10) + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10]


ROMAN = {_roman(n): str(n) for n in range(1, 21)}


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (F.regexp_replace(c, f"[{UNICODE_SPACE}]+", "") != "")


def plain(c: Column) -> Column:
    """Lower case, without marks, look-alike letters, full-width forms and invisible signs."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    c = F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))))
    c = F.regexp_replace(c, r"[\p{Mn}\p{Cf}]+", "")
    c = F.translate(F.lower(c), *LOOKALIKES)
    return F.replace(F.replace(F.translate(c, *MARKED), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae"))


def undecorated(c: Column) -> Column:
    """A typed link target without brackets, alias, heading, block, extension and remarks in parentheses."""
    c = F.regexp_replace(c, r"^\s*!?\[\[|\]\]\s*$", "")
    c = F.regexp_replace(c, r"(?<=\S)\s*(?:[|^]|#(?!\d{1,3}\s*$)).*$", "")
    c = F.regexp_replace(c, rf"[{UNICODE_SPACE}]*[\(\[\{{][^)\]}}]*[\)\]\}}][{UNICODE_SPACE}]*$", "")
    return F.regexp_replace(c, r"(?i)\.md\W*$", "")


def with_readings(df: DataFrame, value: str, most: int) -> DataFrame:
    """Adds (reading, text): a slash ends a folder or parts words, so the value whole, then without its first folders one by one.

    Each part with a letter or digit is a word at least, so of a value with more than ``most`` of them only the last
    ``most`` are read besides the whole; ``most`` is at least the signs of the longest name, so nothing longer could fit.
    """
    df = df.withColumn("_whole", undecorated(F.col(value)))
    df = df.withColumn("_parts", F.filter(F.split("_whole", r"[/\\]"), lambda p: p.rlike(r"[\p{L}\p{N}]")))
    n = F.size("_parts")
    tails = F.transform(F.sequence(F.greatest(F.lit(2), n - (most - 1)), n), lambda i: F.array_join(F.slice("_parts", i, n), "/"))
    texts = F.when(n > 1, F.array_distinct(F.concat(F.array("_whole"), tails))).otherwise(F.array("_whole"))
    return df.select(*(c for c in df.columns if c not in ("_whole", "_parts")), F.posexplode(texts).alias("reading", "text"))


def with_exact(df: DataFrame, text: str) -> DataFrame:
    """Replaces the text by (exact): its words and numbers in order, parted by blanks.

    Roman numerals after the first word and numbers lose their dress. Each step is a column of its own, so that the
    optimiser, which keeps costly columns that are used twice, computes it once.
    """
    c = F.regexp_replace(plain(F.col(text)), r"\b(?:no|nr|num|number)\b[.\s]*(?=\d)", " ")
    c = F.regexp_replace(c, r"['’`´]", "")
    # a word of three letters or more before a dot may be cut short and keeps the dot
    c = F.regexp_replace(c, r"(\p{L}{3,})\.", "$1\u0001 ")
    c = F.regexp_replace(c, r"(?<![\p{L}\p{N}])0+(?=\d+(?![\p{L}\p{N}]))", "")
    c = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\x01]+", " "))
    # what may stand before a name goes, twice at most and never the last word
    c = F.regexp_replace(c, rf"^(?:(?:{LEADING})\x01? +(?=[^ ])){{1,2}}", "")
    df = df.withColumn("_c", c)
    # a Roman numeral is a number only as the last word and after a word, not after a single letter
    df = df.withColumn("_last", F.regexp_extract("_c", r"[^ ]{2} ([ivx]+)$", 1))
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    number = F.try_element_at(roman, F.col("_last"))
    exact = F.coalesce(F.concat(F.regexp_replace("_c", r"[ivx]+$", ""), number), F.col("_c"))
    return df.select(*(x for x in df.columns if x not in (text, "_c", "_last")), exact.alias("exact"))


def edits(length: Column) -> Column:
    """Edits allowed for a word of that length."""
    return F.when(length <= 3, 0).when(length <= 4, 1).otherwise(2)


def whole_edits(length: Column) -> Column:
    return F.when(length <= 4, 0).when(length <= 7, 1).otherwise(2)


def similar_pairs(typed: DataFrame, reference: DataFrame, allowed, most: int = 2) -> DataFrame:
    """(typed, ref, d): all pairs of distinct strings within the edits allowed for the reference's length, ``most`` of them at most."""
    ref = reference.select("ref").distinct().withColumn("k", F.least(F.lit(most), allowed(F.length("ref")))).withColumn("n", F.length("ref"))
    seg = ref.select("ref", "k", "n", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    # segment i of k+1: the lengths differ by one at most
    seg = seg.withColumn("at", F.floor(F.col("i") * F.col("n") / (F.col("k") + 1)).cast("int"))
    seg = seg.withColumn("upto", F.floor((F.col("i") + 1) * F.col("n") / (F.col("k") + 1)).cast("int"))
    seg = seg.withColumn("piece", F.expr("substring(ref, at + 1, upto - at)")).select("ref", "k", "n", "i", "at", "piece", (F.col("upto") - F.col("at")).alias("m"))
    # what to cut out of the typed strings: a row for each reference length and segment
    shapes = seg.select("k", "n", "i", "at", "m").distinct()
    typed = typed.select("typed").distinct().withColumn("len", F.length("typed"))
    lens = typed.select("typed", "len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("len") - most), F.col("len") + most)).alias("n"))
    cut = lens.join(shapes, "n").filter(F.abs(F.col("len") - F.col("n")) <= F.col("k"))
    # of the segments that match, one has no more edits before it than segments, and no more after it: it stands in
    # the typed string at most i places off from its beginning and k - i places off from its end
    shift = F.col("len") - F.col("n")
    low = F.greatest(F.lit(0), F.col("at") - F.col("i"), F.col("at") + shift - F.col("k") + F.col("i"))
    high = F.least(F.col("len") - F.col("m"), F.col("at") + F.col("i"), F.col("at") + shift + F.col("k") - F.col("i"))
    cut = cut.withColumn("low", low).withColumn("high", high).filter("low <= high")
    cut = cut.select("typed", "n", "at", "m", F.explode(F.sequence("low", "high")).alias("p"))
    cut = cut.select("typed", "n", "at", F.expr("substring(typed, p + 1, m)").alias("piece"))
    found = cut.join(seg.select("ref", "k", "n", "at", "piece"), ["n", "at", "piece"]).select("typed", "ref", "k").distinct()
    found = found.withColumn("d", F.levenshtein("typed", "ref")).filter("d <= k")
    # another digit is another thing, never a slip
    found = found.filter(F.regexp_replace("typed", r"\D", "") == F.regexp_replace("ref", r"\D", ""))
    # two edits only as a swap of neighbours, or in a long string
    same = F.array_sort(F.split("typed", "")) == F.array_sort(F.split("ref", ""))
    return found.filter((F.col("d") < 2) | same | (F.length("ref") >= 7)).select("typed", "ref", F.when(same, F.least("d", F.lit(1))).otherwise(F.col("d")).alias("d"))


def _forms(entries: DataFrame, entry: str, names: list[str]) -> DataFrame:
    """(fid, entry, exact, words, letters, numbers, whole): each way an entry may be written."""
    forms = entries.select(F.col(entry).alias("entry"), F.explode(F.array(*names)).alias("form")).filter(not_blank(F.col("form")))
    forms = with_exact(forms, "form").filter("exact <> ''").distinct()
    return _split_words(forms).withColumn("fid", F.monotonically_increasing_id())


def _split_words(df: DataFrame) -> DataFrame:
    """Adds (words, letters, numbers, whole) of the exact text. An umlaut may be written with an e: both writings come out alike."""
    number = r"^\d+$"
    df = df.withColumn("words", F.split(F.regexp_replace("exact", "(?<=[aou])e", ""), " "))
    return (
        df.withColumn("letters", F.filter("words", lambda w: ~w.rlike(number)))
        .withColumn("numbers", F.array_sort(F.filter("words", lambda w: w.rlike(number))))
        .withColumn("whole", F.replace(F.array_join("letters", ""), F.lit("\x01"), F.lit("")))
    )


def map_values(rows: DataFrame, value: str, entries: DataFrame, entry: str, names: list[str]) -> DataFrame:
    """(value, entry) for each distinct value that is neither null nor blank; entry -1 if it has none."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "canonical")
    forms = scratch.write(_forms(entries, entry, names), "forms")
    longest, most_letters = (x or 0 for x in forms.agg(F.max(F.length("exact")), F.max(F.size("letters"))).first())
    typed = rows.select(F.col(value).alias("value")).filter(not_blank(F.col("value"))).distinct()
    # the longest reading that fits counts
    typed = scratch.write(with_exact(with_readings(typed, "value", longest + 1), "text"), "typed")
    cleaned = _split_words(typed.select("exact").filter("exact <> ''").distinct())
    cleaned = scratch.write(cleaned.withColumn("wid", F.monotonically_increasing_id()), "cleaned")

    # as it stands: letters that other stages fold or forgive part names here
    own = forms.groupBy("exact").agg(F.min("entry").alias("entry"), F.max("entry").alias("other")).filter("entry = other").select("exact", "entry")
    by_exact = scratch.write(cleaned.select("wid", "exact").join(own, "exact").select("wid", F.col("entry").cast("long").alias("entry")), "by_exact")
    # a value with a number that no name has fits none
    known = forms.select(F.explode("numbers").alias("number")).distinct()
    strange = cleaned.select("wid", F.explode("numbers").alias("number")).join(known, "number", "left_anti").select("wid").distinct()
    open_ = cleaned.filter(F.size("letters") > 0).join(by_exact.select("wid").unionByName(strange), "wid", "left_anti")
    open_ = scratch.write(open_, "open")

    # by words: each typed word's candidates, then the entries that have a word for every one of them
    ref_words = forms.select(F.explode("letters").alias("ref"))
    typed_words = open_.select(F.explode("letters").alias("as_typed")).distinct().withColumn("typed", F.replace("as_typed", F.lit("\x01"), F.lit("")))
    near = similar_pairs(typed_words.select("typed"), ref_words, edits).join(typed_words, "typed").select("as_typed", "ref", "d")
    begun = ref_words.distinct().select("ref", F.explode(F.expr("transform(sequence(3, greatest(3, length(ref) - 1)), n -> substring(ref, 1, n))")).alias("typed"))
    cut = typed_words.filter(F.col("as_typed").endswith("\x01")).join(begun, "typed").select("as_typed", "ref", F.lit(0).alias("d"))
    pairs = near.unionByName(cut).groupBy("as_typed", "ref").agg(F.min("d").alias("d")).withColumnRenamed("as_typed", "typed")
    pairs = scratch.write(pairs, "pairs")
    in_forms = forms.select("fid", F.col("numbers").alias("form_numbers"), F.size(F.array_distinct("letters")).alias("form_size"), F.posexplode(F.array_distinct("letters")).alias("j", "ref"))
    # each word needs a word of the name to itself, so a value with more words than the name fits it not
    places = open_.filter(F.size("letters") <= most_letters).select("wid", "numbers", F.size("letters").alias("size"), F.posexplode("letters").alias("i", "typed"))
    hits = places.join(pairs, "typed").join(in_forms, "ref")
    hits = hits.filter((F.col("size") <= F.col("form_size")) & (F.size("numbers") <= F.size("form_numbers")) & (F.size(F.array_except("numbers", "form_numbers")) == 0))
    # one exchange serves all three aggregations; a value has few rows, its words times their forms
    hits = hits.select("wid", "fid", "i", (F.shiftleft(F.col("d").cast("long"), 32) + F.col("j")).alias("dj")).repartition("wid")
    best = hits.groupBy("wid", "fid", "i").agg(F.min("dj").alias("dj"))
    fit = best.groupBy("wid", "fid").agg(
        F.count(F.lit(1)).alias("found"), F.size(F.collect_set(F.col("dj").bitwiseAND(0xFFFFFFFF))).alias("refs"), F.sum(F.shiftright("dj", 32)).alias("d")
    )
    fit = fit.join(open_.select("wid", F.size("letters").alias("n"), F.size("words").alias("n_typed")), "wid")
    fit = fit.filter("found = n AND refs = n").join(forms.select("fid", "entry", F.size("words").alias("size")), "fid")
    fit = fit.select("wid", "entry", "d", (F.col("size") > F.col("n_typed")).alias("absent"))
    by_words = scratch.write(_single(fit), "by_words")

    # whole, for values whose words fit no entry: parted, joined and dotted writings
    still = open_.join(by_words, "wid", "left_anti").join(forms.select("numbers").distinct(), "numbers", "left_semi")
    same = similar_pairs(still.select(F.col("whole").alias("typed")), forms.select(F.col("whole").alias("ref")), whole_edits)
    whole = still.select("wid", "numbers", F.col("whole").alias("typed")).join(same, "typed")
    whole = whole.join(forms.select("entry", "numbers", F.col("whole").alias("ref")), ["ref", "numbers"])
    by_whole = _single(whole.select("wid", "entry", "d", F.lit(False).alias("absent")))
    found = by_exact.unionByName(by_words).unionByName(by_whole).filter("entry IS NOT NULL").join(cleaned.select("wid", "exact"), "wid")
    mapped = typed.join(found.select("exact", "entry"), "exact").groupBy("value").agg(F.min(F.struct("reading", "entry")).alias("m"))
    mapped = scratch.write(mapped.select("value", F.col("m.entry").alias("entry")), "mapped")
    values = scratch.write(typed.filter("reading = 0").select("value").join(mapped, "value", "left").select("value", F.coalesce("entry", F.lit(-1).cast("long")).alias("entry")), "values")
    scratch.drop(forms, typed, cleaned, by_exact, open_, pairs, by_words, mapped)
    return values


def _single(fits: DataFrame) -> DataFrame:
    """(wid, entry): the one entry that fits best, null if several fit alike."""
    ranked = fits.select("wid", "entry", (F.col("d") * 2 + F.col("absent").cast("int")).cast("long").alias("rank"))
    per = ranked.groupBy("wid", "entry").agg(F.min("rank").alias("rank"))
    best = per.groupBy("wid").agg(F.min("rank").alias("best"), F.collect_list(F.struct("rank", "entry")).alias("all"))
    top = F.filter("all", lambda x: x["rank"] == F.col("best"))
    return best.select("wid", F.when(F.size(top) == 1, top[0]["entry"]).cast("long").alias("entry"))


def unresolved_topics(links: DataFrame, topics: DataFrame) -> DataFrame:
    """p4_found: (link_id, topic_id) of unresolved links with a typed target."""
    open_links = links.filter(F.col("target_path").isNull() | (F.col("target_path") == "")).filter(not_blank(F.col("target"))).select("link_id", "target")
    mapped = map_values(open_links, "target", topics, "topic_id", ["name", "aka"])
    return skew_join(open_links, mapped.withColumnRenamed("value", "target"), "target").select("link_id", F.col("entry").alias("topic_id"))


def unmatched_report(links: DataFrame, topics: DataFrame) -> DataFrame:
    """(target, n_links) of the typed values that map to no entry."""
    found = unresolved_topics(links, topics).filter("topic_id = -1").select("link_id")
    return links.select("link_id", "target").join(found, "link_id", "left_semi").groupBy("target").agg(F.count(F.lit(1)).alias("n_links"))
