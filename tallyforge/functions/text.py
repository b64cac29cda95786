"""Text as Column expressions: n-grams, similarity, normalisers, truncation, features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; none for a shorter text."""
    some = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))  # one pass, however long the text
    return F.when(F.length(text) >= n, some).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two sets, 0 when both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def bigram_counts(text: Column) -> Column:
    """Map of character bigrams to how often they occur."""
    grams = F.when(F.length(text) >= 2, F.regexp_extract_all(text, F.lit("(?s)(?=(.{2}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.map_from_entries(F.transform(F.array_distinct(grams), lambda g: F.struct(g, F.size(F.filter(grams, lambda x: x == g)))))


def dice(a: Column, b: Column) -> Column:
    """Multiset bigram Dice of two texts: 1 when equal, 0 when neither has a bigram."""
    ma, mb = bigram_counts(a), bigram_counts(b)
    both = F.aggregate(F.map_values(F.map_zip_with(ma, mb, lambda k, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))), F.lit(0), lambda s, x: s + x)
    total = F.greatest(F.length(a) - 1, F.lit(0)) + F.greatest(F.length(b) - 1, F.lit(0))
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * both / total)


def near_identical(a: Column, b: Column, least: int = 20, length_ratio: float = 0.8, limit: float = 0.9) -> Column:
    """Equal, or both long enough, of similar length, and with a Dice of `limit` at least."""
    la, lb = F.length(a), F.length(b)
    gate = (F.least(la, lb) >= least) & (F.least(la, lb) >= length_ratio * F.greatest(la, lb))
    return F.when(a == b, F.lit(True)).when(~gate, F.lit(False)).otherwise(dice(a, b) >= limit)


def normalised_name(c: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """Lower case, _ as -, without the first matching prefix."""
    out = F.translate(F.lower(c), "_", "-")
    return F.regexp_replace(out, "^(" + "|".join(prefixes) + ")", "") if prefixes else out


def terms(text: Column) -> Column:
    """Words `[a-z][a-z0-9]+` of three letters or more, lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)


def normalised_command(c: Column, limit: int = 300) -> Column:
    """Trimmed, lower case, blanks collapsed, digits as 0, cut."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), "[0-9]+", "0"), F.lit(limit))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.octet_length(F.encode(c, "UTF-16LE")) / 2


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def terminal_view(c: Column, lines: int = 40, width: int = 200) -> Column:
    """The last lines, each cut, under a note when lines were left out."""
    every = F.split(c, "\n")
    kept = F.transform(F.slice(every, F.greatest(F.size(every) - lines + 1, F.lit(1)), F.lit(lines)), lambda x: F.left(x, F.lit(width)))
    note = F.concat(F.lit("["), (F.size(every) - lines).cast("string"), F.lit(" lines left out]"))
    return F.array_join(F.when(F.size(every) > lines, F.concat(F.array(note), kept)).otherwise(kept), "\n")


def trimmed(c: Column, mode: str) -> Column:
    """Parts of an output: all, last200, last40, first40, first20last20."""
    every = F.split(c, "\n")
    n = F.size(every)
    last = lambda k: F.slice(every, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
    first = lambda k: F.slice(every, F.lit(1), F.lit(k))
    if mode == "all":
        return c
    if mode == "first20last20":
        return F.array_join(F.when(n <= 40, every).otherwise(F.concat(first(20), last(20))), "\n")
    kind, k = (first, int(mode[5:])) if mode.startswith("first") else (last, int(mode[4:]))
    return F.array_join(kind(k), "\n")


def runaway(c: Column, least: int = 20_000, tail: int = 400, low: int = 20, high: int = 80, lines: int = 60, repeats: int = 8, shortest: int = 20) -> Column:
    """A long text whose end repeats with a period, or one of whose last complete lines
    recurs. Lines count without blanks at both ends, and only from `shortest` characters
    on, since code repeats short lines; the line behind the last line end may still grow."""
    # a value that a lambda looks at again and again is bound once, as the only element of an array
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    periods = F.sequence(F.lit(low), F.lit(high))
    periodic = bound(F.right(c, F.lit(tail)), lambda end: (F.length(end) >= tail) & F.exists(periods, lambda p: F.substr(end, p + 1) == F.left(end, F.lit(tail) - p)))
    whole = bound(F.split(c, "\n"), lambda every: F.slice(every, F.greatest(F.size(every) - lines, F.lit(1)), F.least(F.size(every) - 1, F.lit(lines))))
    rows = F.filter(F.transform(whole, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= shortest)
    repeated = bound(rows, lambda r: F.exists(F.array_distinct(r), lambda x: F.size(F.filter(r, lambda y: y == x)) >= repeats))
    return (F.length(c) >= least) & (periodic | repeated)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving: log2 of the length comparisons."""
    step = lambda s, _: F.when(F.left(a, ((s["lo"] + s["hi"] + 1) / 2).cast("int")) == F.left(b, ((s["lo"] + s["hi"] + 1) / 2).cast("int")), F.struct(((s["lo"] + s["hi"] + 1) / 2).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (((s["lo"] + s["hi"] + 1) / 2).cast("int") - 1).alias("hi")))
    start = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, lambda s, i: F.when(s["lo"] >= s["hi"], s).otherwise(step(s, i)))["lo"]


def group_key(c: Column) -> Column:
    """A task's name without its `__suffix` and `_runN`."""
    return F.regexp_replace(F.split_part(c, F.lit("__"), F.lit(1)), "_run[0-9]+$", "")


def size_to_mb(c: Column) -> Column:
    """Sizes such as 8G, 512M, 1T, 2048K in MB; null for anything else."""
    n = F.try_to_number(F.regexp_extract(c, r"^([0-9]+)", 1), F.lit("9999999999")).cast("double")
    unit = F.upper(F.regexp_extract(c, r"^[0-9]+\s*([KMGTkmgt]?)[Ii]?[Bb]?$", 1))
    ok = F.rlike(c, F.lit(r"^[0-9]+\s*[KMGTkmgt]?[Ii]?[Bb]?$"))
    return F.when(ok, n * F.when(unit == "K", 1 / 1024).when(unit == "G", 1024.0).when(unit == "T", 1048576.0).when(unit == "M", 1.0).otherwise(1 / 1048576))


def image_parts(c: Column) -> Column:
    """registry, repository and tag of a container image reference."""
    first = F.split_part(c, F.lit("/"), F.lit(1))
    has = c.contains("/") & (first.contains(".") | first.contains(":") | (first == "localhost"))
    rest = F.when(has, F.substr(c, F.length(first) + 2)).otherwise(c)
    tag = F.regexp_extract(rest, ":([^:/]+)$", 1)
    return F.struct(F.when(has, first).alias("registry"), F.regexp_replace(rest, ":[^:/]+$", "").alias("repository"), F.when(tag == "", "latest").otherwise(tag).alias("tag"))


def _fitting(lines: Column, most_lines: int, most_bytes: int) -> Column:
    """struct(lines, bytes): how many of the first lines fit, and their bytes with line ends between."""
    start = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("bytes"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        size = s["bytes"] + F.octet_length(x) + F.when(s["lines"] > 0, 1).otherwise(0)
        fits = s["open"] & (s["lines"] < most_lines) & (size <= most_bytes)
        return F.struct(F.when(fits, s["lines"] + 1).otherwise(s["lines"]).alias("lines"), F.when(fits, size.cast("long")).otherwise(s["bytes"]).alias("bytes"), fits.alias("open"))

    return F.aggregate(lines, start, step)


def head_by_lines_and_bytes(c: Column, most_lines: int, most_bytes: int) -> Column:
    """struct(lines, bytes, cut_by) of the whole lines kept from the start; cut_by is whole, lines or bytes."""
    every = F.split(c, "\n")
    s = _fitting(every, most_lines, most_bytes)
    cut = F.when((F.size(every) <= most_lines) & (F.octet_length(c) <= most_bytes), "whole").when(s["lines"] < F.least(F.size(every), F.lit(most_lines)), "bytes").otherwise("lines")
    return F.struct(s["lines"].alias("lines"), s["bytes"].alias("bytes"), cut.alias("cut_by"))


def tail_by_lines_and_bytes(c: Column, most_lines: int, most_bytes: int) -> Column:
    """struct(lines, bytes) of the whole lines kept from the end."""
    s = _fitting(F.reverse(F.split(c, "\n")), most_lines, most_bytes)
    return F.struct(s["lines"].alias("lines"), s["bytes"].alias("bytes"))


def base_image(c: Column) -> Column:
    """The image of a build file's first FROM line, without its name for later stages."""
    return F.regexp_extract(c, r"(?mi)^FROM\s+(?:--\S+\s+)?(\S+)", 1)


def build_prefix_hash(c: Column) -> Column:
    """SHA-256 of the lines before the first COPY or ADD, without comments, blank lines and stage names."""
    lines = F.filter(F.split(c, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))
    step = lambda s, x: F.struct(F.when(s["open"] & ~F.rlike(x, F.lit(r"(?i)^\s*(COPY|ADD)\s")), F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"), (s["open"] & ~F.rlike(x, F.lit(r"(?i)^\s*(COPY|ADD)\s"))).alias("open"))
    kept = F.transform(F.aggregate(lines, start, step)["kept"], lambda x: F.regexp_replace(x, r"(?i)^(FROM\s+\S+)\s+AS\s+\S+\s*$", "$1"))
    return F.sha2(F.array_join(kept, "\n").cast("binary"), 256)


def test_counts(c: Column) -> Column:
    """(passed, failed) of the last pytest or unittest summary, errors counted as failed;
    null where there is none."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.lit(-1)).cast("int")
    zero = lambda x: F.coalesce(x, F.lit(0))
    passed, failed, errors = last(r"\b([0-9]+) passed"), last(r"\b([0-9]+) failed"), last(r"\b([0-9]+) errors?\b")
    ran = last(r"Ran ([0-9]+) tests?")
    bad = F.try_element_at(F.regexp_extract_all(c, F.lit(r"FAILED \(([^)]*)\)"), F.lit(1)), F.lit(-1))
    count = lambda word: zero(F.nullif(F.regexp_extract(bad, rf"{word}=([0-9]+)", 1), F.lit("")).cast("int"))
    wrong = zero(count("failures") + count("errors"))
    return F.when(passed.isNotNull() | failed.isNotNull(), F.struct(zero(passed).alias("passed"), (zero(failed) + zero(errors)).alias("failed"))).when(ran.isNotNull(), F.struct((ran - wrong).alias("passed"), wrong.alias("failed")))
