"""Line deduplication by prefix doubling over line-ID sequences, with DataFrame operations only.

Lines: a text is cut after each newline and, as passages are often pasted into the middle of a line, also before a
capitalised word and after a lower-case word with a stop. What is still longer than LONG bytes is cut before short
words, so that a stretch without capitals or stops has cuts that its content sets. A text is then a sequence of line IDs.

Suffixes are compared by prefix doubling: the name of 2**(k+1) lines at a place is made of the names of 2**k lines there
and 2**k lines further on, so two places have one name at depth k just if their suffixes share 2**k lines. Places of one
name are an interval of the suffix array whose longest common prefix is that long; a prefix of another length lies in
such an interval by two overlapping names. Names are made inside each text; only names that occur again are sorted
by place.

A maximal repeated run counts from MIN_WORDS words on. Its lines are just those of its shortest runs of MIN_WORDS words:
the one that starts at a line and the one that ends there. Such a run is a later copy if its interval holds an
earlier place. So doubling goes as deep as shortest runs are long; deeper names delete nothing more
(tests hold the result against maximal runs of a whole suffix array).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MIN_WORDS = 25
#: A cut consumes the one character that ends a line.
CUT = r"[ \n](?:(?<=\n)(?!\s)|(?<= )(?:(?=\p{Lu}(?!\p{Lu}))|(?<=\p{Ll}[.!?] )(?! )))"
#: The same cuts without consuming anything, so that the lines put together are the text.
CUT_AFTER = r"(?<=[ \n])(?:(?<=\n)(?!\s)|(?<= )(?:(?=\p{Lu}(?!\p{Lu}))|(?<=\p{Ll}[.!?] )(?! )))"
#: Lines of more bytes than this are cut again, before a word of at most three letters that one of seven or more follows.
LONG = 1000
SHORT = r" (?=\p{L}{1,3} \p{L}{7})"
SHORT_AFTER = r"(?<= )(?=\p{L}{1,3} \p{L}{7})"
#: Bits, as a power of two, of the largest bitmap that keeps runs without a copy out of the sort, and of the one that keeps
#: untouched texts out of the last join. Full bitmaps cost work, never a run.
RUN_BITS, TEXT_BITS = 26, 22
#: Names with more than this share of all places are joined by broadcast; there are at most 1 / HOT of them.
HOT = 1 / 1000
#: Shortest runs of up to so many lines (a power of two) are found and named by plain columns, longer ones by array functions.
NEAR = 8
_BLANK = r" \n\r\t"
_NO_ID = -(1 << 63)
#: Never false. The optimizer can't push filters through a column that holds it, which would compute the column a second time below.
_HELD = "monotonically_increasing_id() >= 0"


def _lines(cut: str, again: str):
    # without white space behind, a line is as long with the character of its cut as without
    long = f"octet_length(l) > {LONG} AND octet_length(rtrim(' \\n', l)) > {LONG}"
    return F.expr(f"flatten(transform(split(_text, r'{cut}', -1), l -> IF({long}, split(l, r'{again}', -1), array(l))))")


def _text_key(text):
    return F.xxhash64(text)


def _plain(text):
    """Whether single spaces and newlines alone separate words, so that spaces count them."""
    odd = text.startswith(" ") | text.startswith("\n") | text.endswith(" ") | text.endswith("\n")
    for marks in ("  ", "\n ", " \n", "\n\n", "\t", "\r", "\x0b", "\f"):
        odd = odd | text.contains(marks)
    return ~odd


def _texts(docs: DataFrame) -> DataFrame:
    """One row per text: doc, text_key, and of each line its ID, a second hash (check) and its number of words."""
    rows = docs.where(F.col("_text") != "").select("doc", _text_key(F.col("_text")).alias("text_key"), _plain(F.col("_text")).alias("plain"), _lines(CUT, SHORT).alias("lines"))
    trimmed = f"rtrim('{_BLANK}', l)"
    return rows.select(
        "doc", "text_key",
        F.expr(f"IF(plain, transform(lines, l -> xxhash64(l)), transform(lines, l -> xxhash64({trimmed})))").alias("ids"),
        F.expr(f"IF(plain, transform(lines, l -> hash(l)), transform(lines, l -> hash({trimmed})))").alias("checks"),
        F.expr(
            "IF(plain, transform(lines, l -> IF(l = '', 0, octet_length(l) - octet_length(replace(l, ' ', '')) + 1)),"
            r" transform(lines, l -> size(regexp_extract_all(l, r'\S+', 0))))"
        ).alias("words"),
    )


def _sized(rows: DataFrame, at: str, step: int, min_words: int, name: str) -> DataFrame:
    """Adds, as column `name`, the lines of the shortest run of min_words words from line `at` on (step 1) or back (step -1): 0 if the
    text has none, -1 if it has more than NEAR lines, or none."""
    sums = [f"{name}_{n}" for n in range(1, NEAR + 1)]
    rows = rows.withColumn(sums[0], F.expr(f"get(words, {at})"))
    for n in range(1, NEAR):
        rows = rows.withColumn(sums[n], F.expr(f"{sums[n - 1]} + get(words, {at} + {step * n})"))
    cases = " ".join(f"WHEN {x} >= {min_words} THEN {n + 1}" for n, x in enumerate(sums))
    return rows.withColumn(name, F.expr(f"IF({_HELD}, CASE {cases} WHEN {sums[-1]} IS NULL THEN 0 ELSE -1 END, 0)")).drop(*sums)


def _named(rows: DataFrame, start: str, names: dict[str, str]) -> DataFrame:
    """Adds names of runs of at most NEAR lines from line `start` on: column -> column with the run's lines. The doubling's names are columns
    n{depth}_{line}, dropped at the end."""
    made = [f"n0_{i}" for i in range(NEAR)]
    rows = rows.withColumns({c: F.expr(f"get(ids, {start} + {i})") for i, c in enumerate(made)})
    depth = 0
    while 2 << depth <= NEAR:
        half, depth = 1 << depth, depth + 1
        level = {f"n{depth}_{i}": F.expr(f"xxhash64(n{depth - 1}_{i}, n{depth - 1}_{i + half})") for i in range(NEAR + 1 - 2 * half)}
        rows = rows.withColumns(level)
        made += level
    for name, size in names.items():
        cases = []
        for n in range(1, NEAR + 1):
            k = n.bit_length() - 1
            cases.append(f"WHEN {n} THEN " + (f"n{k}_0" if n == 1 << k else f"xxhash64({n}, n{k}_0, n{k}_{n - (1 << k)})"))
        rows = rows.withColumn(name, F.expr(f"IF({_HELD}, CASE {size} {' '.join(cases)} END, NULL)"))
    return rows.drop(*made)


def _far_size(lines: str, min_words: int) -> str:
    """SQL: how many of the first lines, given by their words, have min_words words; 0 if all of them have fewer."""
    # words in the lower 16 bits, lines above; most are found among the first lines
    enough = f"(a & 65535) >= {min_words}"
    count = f"aggregate({{}}, 0, (a, y) -> IF({enough}, a, a + 65536 + least(y, {min_words})), a -> IF({enough}, shiftright(a, 16), {{}}))"
    return f"coalesce({count.format(f'slice({lines}, 1, {min_words + 1})', 'NULL')}, {count.format(lines, '0')})"


_SPAN = ["doc", "text_key", "start", "size", "name", "check", "h"]


def _starting(texts: DataFrame, min_words: int) -> DataFrame:
    rows = texts.select("doc", "text_key", "ids", "checks", "words", F.posexplode("words").alias("start", "here")).drop("here")
    return _sized(rows, "start", 1, min_words, "size")


def _ending(texts: DataFrame, min_words: int) -> DataFrame:
    rows = texts.select("doc", "text_key", "ids", "checks", "words", F.posexplode("words").alias("end", "here")).drop("here")
    return _sized(rows, "end", -1, min_words, "size")


def _check(rows: DataFrame) -> DataFrame:
    return rows.withColumn("check", F.expr("hash(slice(checks, start + 1, size))"))


def _far_runs(texts: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of more than NEAR lines, those of a word or two, as spans; their names are made of their lines' IDs at once."""
    # lines without a word don't follow each other (see CUT), but for two at a text's end
    most = 2 * min_words + 1
    lists = ("ids", "checks", "words")
    forth = _starting(texts, min_words).where("size = -1")
    forth = forth.select("doc", "text_key", "start", *[F.expr(f"slice({c}, start + 1, {most})").alias(c) for c in lists])
    forth = forth.withColumn("size", F.expr(f"IF({_HELD}, {_far_size('words', min_words)}, 0)")).where("size > 0").withColumn("first", F.col("size"))
    back = _ending(texts, min_words).where("size = -1").withColumn("low", F.expr(f"greatest(end + 1 - {most}, 0)"))
    back = back.select("doc", "text_key", "end", *[F.expr(f"slice({c}, low + 1, end + 1 - low)").alias(c) for c in lists])
    back = back.withColumn("size", F.expr(f"IF({_HELD}, {_far_size('reverse(words)', min_words)}, 0)")).where("size > 0")
    back = back.select("doc", "text_key", F.expr("end + 1 - size").alias("start"), *[F.expr(f"slice({c}, -size, size)").alias(c) for c in lists], "size")
    back = back.withColumn("first", F.expr(f"IF({_HELD}, {_far_size('words', min_words)}, 0)")).where("first <> size")
    name = "xxhash64({0}, slice(ids, 1, {0}))"
    rows = _named(forth.unionByName(back), "0", {"near": "first"}).withColumn("name", F.expr(name.format("size")))
    return rows.withColumns({"check": F.expr("hash(slice(checks, 1, size))"), "h": F.expr(f"IF(first <= {NEAR}, near, {name.format('first')})")}).select(*_SPAN)


def _near_forth(texts: DataFrame, min_words: int) -> DataFrame:
    return _named(_starting(texts, min_words), "start", {"name": "size"})


def _near_back(texts: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of at most NEAR lines that end at a line, but for those that are the shortest from their first line, too."""
    rows = _ending(texts, min_words).where("size > 0").withColumn("start", F.expr("end + 1 - size"))
    rows = _sized(rows, "start", 1, min_words, "first").where("first <> size")
    return _named(rows, "start", {"name": "size", "h": "first"})


def _bitmap(hashes: DataFrame, bits: int) -> DataFrame:
    """(_word, _bits) of a bitmap of 2**bits bits in which the bits of the column h are set."""
    bit = hashes.select(F.pmod("h", F.lit(1 << bits)).alias("bit"))
    return bit.groupBy(F.shiftright("bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("_bits"))


def _marked(rows: DataFrame, column: str, bitmap: DataFrame, bits: int, how: str = "inner") -> tuple[DataFrame, object]:
    """The rows joined with the bitmap's words, and whether the bit of a row's column is set."""
    # 2**(bits - 6) rows of two numbers at most
    bit = F.pmod(F.col(column), F.lit(1 << bits))
    joined = rows.join(F.broadcast(bitmap), F.shiftright(bit, 6) == F.col("_word"), how)
    return joined, F.coalesce(F.getbit("_bits", (bit % 64).cast("int")), F.lit(0)) == 1


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Lines to delete, by doc (doc_id; the least long for null) and text_key: words array<struct<word int, bits long>>, a bitmap of
    line positions; see dedup_lines."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("text").cast("string").alias("_text"))
    texts = scratch.keep(_texts(docs), "texts")
    far = scratch.keep(_far_runs(texts, min_words), "far")
    names = _near_forth(texts, min_words).select("name").unionByName(far.where("name = h").select("name"))
    # texts' last lines start no run; count(name) leaves them out
    again = names.groupBy("name").agg(F.count("name").alias("places")).where("places > 1").select(F.col("name").alias("h"))
    again = scratch.keep(again, "again")
    bits = min(RUN_BITS, max(16, (16 * again.count()).bit_length()))
    bitmap = scratch.keep(_bitmap(again, bits), "bitmap")
    # a run is repeated only if the shortest one that starts at its first line is
    spans = None
    for part in (_near_forth(texts, min_words).withColumn("h", F.col("name")), _near_back(texts, min_words), far):
        joined, marked = _marked(part, "h", bitmap, bits)
        part = joined.where(marked)
        part = (part if "check" in part.columns else _check(part)).select(*_SPAN[:-1])
        spans = part if spans is None else spans.unionByName(part)
    spans = scratch.keep(spans, "spans")
    columns = spans.columns
    scratch.drop("texts")
    place = F.struct("doc", "text_key", "start")
    first = spans.groupBy("name", "check").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = scratch.keep(first, "first")
    most = max(1, int(HOT * spans.count()))
    hot = F.broadcast(first.where(F.col("places") > most))
    later = spans.join(hot, ["name", "check"]).select(*columns, "first").unionByName(
        spans.join(hot, ["name", "check"], "left_anti").join(first.where(F.col("places") <= most).hint("shuffle_hash"), ["name", "check"]).select(*columns, "first")
    )
    later = later.where(place > F.col("first"))
    # a run has at most 2 * min_words + 1 lines; it sets bits in the words from that of its first line to that of its last
    word = F.explode(F.expr("sequence(shiftright(start, 6), shiftright(start + size - 1, 6))")).alias("word")
    lit = later.select("doc", "text_key", "start", "size", word)
    low, high = F.expr("greatest(start - 64 * word, 0)"), F.expr("least(start + size - 1 - 64 * word, 63)")
    lit = lit.select("doc", "text_key", "word", low.alias("low"), high.alias("high"))
    lit = lit.withColumn("bits", F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (high - low)), low)"))
    dead = lit.groupBy("doc", "text_key", "word").agg(F.bit_or("bits").alias("bits"))
    return dead.groupBy("doc", "text_key").agg(F.collect_list(F.struct("word", "bits")).alias("words"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """`docs` (doc_id long, text string, more columns kept) with column lines_deleted int added (in place of one of that
    name) and `text` without the lines that lie in a later copy of a repeated run of at least min_words words.

    The earliest place (smallest doc_id, nulls first; of several texts of one id that with the smallest hash; then within
    the text) keeps its run. Null and empty texts are left alone. Rows that repeat an id and a text count as one place
    and are edited alike. A text can become empty. Very long texts are processed whole; an empty table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    before = len(scratch.kept)
    dead = scratch.keep(repeated_lines(docs, min_words, scratch), "dead")
    for name in scratch.kept[before:-1]:
        scratch.drop(name)
    dead = dead.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), F.col("words").alias("_dead"), F.xxhash64("doc", "text_key").alias("h"))
    # a bitmap of fixed size tells which texts can't have lines to delete, so that they aren't shuffled
    bitmap = scratch.keep(_bitmap(dead, TEXT_BITS), "dead-bitmap")
    names = [c for c in docs.columns if c != "lines_deleted"]
    text = F.col("text").cast("string")
    # the columns go as one, so that none of theirs can clash with ours
    rows = docs.select(F.struct(*names).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), text.alias("_text"))
    rows = rows.withColumn("_text_key", _text_key(F.col("_text"))).withColumn("_h", F.xxhash64("_id", "_text_key"))
    rows, marked = _marked(rows, "_h", bitmap, TEXT_BITS, "left")
    kept = [F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in names]
    clear = rows.where(~marked).select(*kept, F.lit(0).alias("lines_deleted"))
    rows = rows.where(marked).select("_row", "_id", "_text", "_text_key")
    rows = rows.join(dead.drop("h").hint("shuffle_hash"), (F.col("_id") == F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")
    # a row's number, which is never negative, keeps a caller's filter above these columns; below, it would split the text once per line
    some = F.col("_dead").isNotNull() & (F.monotonically_increasing_id() >= 0)
    rows = rows.withColumn("_bits", F.when(F.col("_dead").isNotNull(), F.map_from_entries("_dead"))).withColumn("_lines", F.when(some, _lines(CUT_AFTER, SHORT_AFTER)))
    rows = rows.withColumn("_left", F.expr("filter(_lines, (l, i) -> coalesce(shiftright(_bits[shiftright(i, 6)], i & 63) & 1, 0) = 0)"))
    edited = [F.when(F.col("_dead").isNull(), F.col("_text")).otherwise(F.array_join("_left", "")).alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in names]
    gone = F.when(F.col("_dead").isNull(), 0).otherwise(F.size("_lines") - F.size("_left"))
    return clear.unionByName(rows.select(*edited, gone.alias("lines_deleted")))
