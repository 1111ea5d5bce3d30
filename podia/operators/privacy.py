"""Real names in what is to be published: texts, code and data files are searched for the riders' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podia.functions import text as X

# What a name looks like, and the words and stretches that may be one.
CJK_NAME, CJK_LENGTHS = f"^{X.CJK}{{3,4}}$", (3, 4)
LATIN_WORD, LATIN_WORDS = r"[A-Za-zÀ-ÿ'’.\-]+", (2, 3, 4)
LATIN_NAME = rf"^{LATIN_WORD}( {LATIN_WORD}){{1,3}}$"
LINE_ENDS = r"[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BETWEEN_VALUES = r"[\s\x{3000},/()（）·、&+]+"
JSON_TEXT = r'"((?:[^"\\]|\\.)*)"'
#: Bits of the filter that stretches pass before they meet the names; it is broadcast as a row per 64 bits that are in use.
FILTER_BITS = 1 << 24


def latin_key(name: Column) -> Column:
    """A Latin name as it is compared: single spaces, without case."""
    return F.replace(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def name_keys(names: DataFrame) -> DataFrame:
    """(key): the names that are looked for: CJK ones of three or four characters, and Latin ones of two to four words."""
    name = X.stripped(F.col("name"))
    plain = F.regexp_replace(name, r"\s+", " ")
    return names.select(F.when(name.rlike(CJK_NAME), name).when(plain.rlike(LATIN_NAME), latin_key(plain)).alias("key")).filter("key is not null").distinct()


def _runs(size: Column, n: int, piece) -> Column:
    """piece(i) for each place i from which n of `size` things stand in a row."""
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), piece)).otherwise(F.array().cast("array<string>"))


def _cuts(run: Column, n: int) -> Column:
    return _runs(F.length(run), n, lambda i: F.substring(run, i, F.lit(n)))


def _in_text(text: Column) -> tuple[Column, Column]:
    """Stretches of running text that may be a name: CJK ones, and runs of as many Latin words as a name may have, in the form of latin_key, one for each word that another follows."""
    cjk = F.regexp_extract_all(text, F.lit(f"{X.CJK}{{3,}}"), F.lit(0))
    latin = F.transform(F.split(text, LINE_ENDS), lambda line: F.regexp_extract_all(line, F.lit(LATIN_WORD), F.lit(0)))
    latin = F.filter(latin, lambda words: F.size(words) > 1)
    latin = F.transform(latin, lambda words: F.split(latin_key(F.array_join(words, " ")), " "))
    most = LATIN_WORDS[-1]
    runs = F.transform(latin, lambda words: F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, most), " ")))
    return F.flatten(F.transform(cjk, lambda run: F.concat(*[_cuts(run, n) for n in CJK_LENGTHS]))), F.flatten(runs)


def _in_json(text: Column) -> Column:
    """The strings of a JSON text, keys and values however deep, whole and in their parts, that may be a name."""
    strings = F.transform(F.regexp_extract_all(text, F.lit(JSON_TEXT), F.lit(1)), lambda s: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), 0), s))
    values = F.flatten(F.transform(strings, lambda s: F.array_distinct(F.concat(F.array(F.trim(s)), F.split(F.trim(s), BETWEEN_VALUES)))))
    return F.filter(values, lambda v: v.rlike(CJK_NAME) | F.regexp_replace(v, r"\s+", " ").rlike(LATIN_NAME))


def exposed_names(texts: DataFrame, names: DataFrame, text_col: str = "text", json_col: str | None = None, allowed: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., key, hits): names of `names` (name) that stand in texts meant for publication, and how often.

    In running text, CJK names of three or four characters are found anywhere in a run, Latin
    ones of two to four words on a line, without case. Where json_col is
    true the text is JSON: only its strings and their parts count, as wholes. Names in `allowed`
    (sha: SHA-256 of the name in hex) are passed over. A null text holds nothing; empty tables give none.

    Stretches that may be a name pass a filter of one bit per hash of a name before
    they are shuffled to meet the names: FILTER_BITS / 64 rows at most, whatever the number of names. Latin words
    pass it by the first two words of names, once for each word; only what passes is tried as names of each length.
    """
    by = by or []
    keys = name_keys(names)
    if allowed is not None:
        keys = keys.join(allowed.select(F.lower("sha").alias("sha")).distinct(), F.sha2("key", 256) == F.col("sha"), "left_anti")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    cjk, latin = _in_text(text)
    if json_col is None:
        whole, runs = cjk, latin
    else:
        of_json = F.col(json_col)
        whole, runs = F.when(of_json, _in_json(text)).otherwise(cjk), F.when(of_json, none).otherwise(latin)
    stretch = lambda c, run: F.transform(c, lambda x: F.struct(x.alias("stretch"), F.lit(run).alias("run")))
    found = texts.select(*by, F.explode(F.concat(stretch(whole, False), stretch(runs, True))).alias("f")).select(*by, "f.*")
    key = F.when(F.col("run") | F.col("stretch").rlike(CJK_NAME), F.col("stretch")).otherwise(latin_key(F.col("stretch")))
    found = found.select(*by, "run", key.alias("key"))

    start = F.substring_index("key", " ", 2)
    bit = F.pmod(F.xxhash64(start), F.lit(FILTER_BITS))
    word, place = F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(63).cast("int").alias("place")
    known = keys.select(word, place).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    passed = found.select("*", word, place).join(F.broadcast(known), "word").filter("getbit(bits, place) = 1")
    each = F.when(F.col("run"), F.filter(F.array(*[F.when(F.size(F.split("key", " ")) >= n, F.substring_index("key", " ", n)) for n in LATIN_WORDS]), lambda x: x.isNotNull())).otherwise(F.array("key"))
    passed = passed.select(*by, F.explode(each).alias("key"))
    return passed.groupBy(*by, "key").agg(F.count("*").alias("hits")).join(keys, "key").select(*by, "key", "hits")
