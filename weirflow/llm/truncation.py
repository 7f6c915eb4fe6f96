"""Texts that end before their author ended them.

The corpus says what a complete end looks like. Its words form a trie, held as a table of nodes (prefix, is it a word, does it go on), and a
final token that is no word but the proper prefix of words was cut. Its lines, and their shapes (words and numbers as classes), show
which lines are complete: a last line whose text or shape never closes a line elsewhere, and that ends in no sentence mark, was cut. How a line ends is weighed in shares (line breaks
after it, ends of texts, lines that go on after it), so that a larger corpus of the same kind gives the same verdict; half words and broken records count in any case. Lengths at which texts of a source pile up are that
source's limits. All counts cover all distinct texts, however long their lines and words; words and the hashes of lines and shapes are combined within each partition before they are shuffled, and only those that a last line asks for are kept.

Defined cases: null, empty and blank texts are never cut. Texts that end in a line break are complete unless a mark of the cut stands there.
Copies of a text are judged alike and count once in the statistics. Documents without a source are judged by the corpus as the others are; the report has them under null. Any other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.session import bounded_broadcast, cut

#: Distinct texts in which a shape must close a line to count as complete.
KNOWN = 3
#: A last line is complete where a line break follows it in at least this share of the distinct texts in which it ends a line or the text, unless lines go on after it this many times as often.
CLOSED_SHARE, GOES_ON = 0.1, 20
#: A source's limit: at least so many distinct texts of one length, and so many times the mean of the lengths around it.
PILE, PILE_RATIO, AROUND = 8, 8.0, 20

#: Blanks that a text may end in.
_BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_MARK = r"(?i)(?:[\[(<](?:[^\[\]()<>\n]{0,40}\b)?(?:truncated|cut off|cut|snip|snipped|gekürzt|tronqué|truncado|省略|以下略)\b?[^\[\]()<>\n]{0,40}[\])>])\s*\z"
#: Longest mark of a cut in characters: the pattern's bounds and its longest word.
MARK_CHARS = 100
_SENTENCE = list(".!?。！？:;」』）)]}|`>\"”»’'*")
_WORD = r"(?<!\p{L})\p{L}++\z"


def _core(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def tails(docs: DataFrame) -> DataFrame:
    """What the end of each text shows: doc_id, source, digest, chars, octets, mark, dots, line_key, shape_key, line, token, closed, sentence, open_point, json_cut, fence_open."""
    text = F.col("text")
    d = docs.select("doc_id", "source", text, _core(text).alias("core")).filter(F.coalesce(F.col("core") != "", F.lit(False)))
    d = d.withColumn("mark", F.right("core", F.lit(MARK_CHARS)).rlike(_MARK)).withColumn("core", F.when(F.col("mark"), _core(F.regexp_replace("core", _MARK, ""))).otherwise(F.col("core")))
    end = lambda n: F.right("core", F.lit(n))
    d = d.withColumn("line", F.substring_index("core", "\n", -1)).withColumn("dots", (end(1) == "…") | (end(3) == "..."))
    fences = F.size(F.regexp_extract_all(text, F.lit(r"(?md)^[ \t\x0B\f\r]*```"), F.lit(0)))
    return d.select(
        "doc_id",
        "source",
        F.xxhash64(text).alias("digest"),
        F.length(text).alias("chars"),
        F.octet_length(text).alias("octets"),
        "mark",
        "dots",
        clean_lines(F.col("line")).alias("line"),
        F.xxhash64(F.lit("l"), clean_lines(F.col("line"))).alias("line_key"),
        F.xxhash64(F.lit("s"), shape(F.col("line"))).alias("shape_key"),
        F.regexp_extract("line", _WORD, 0).alias("token"),
        F.rtrim(text, F.lit(" \t\r")).endswith("\n").alias("closed"),
        end(1).isin(_SENTENCE).alias("sentence"),
        end(4).rlike(r"(?:(?<![0-9A-Za-z_])[0-9]{1,2}|\b[A-Z]|\b(?:St|Nr|Mr|Mrs|Dr))\.\z").alias("open_point"),
        (F.ltrim("line").startswith('{"') & F.try_parse_json("line").isNull()).alias("json_cut"),
        (fences % 2 == 1).alias("fence_open"),
    )


def clean_lines(text: Column) -> Column:
    """A text whose lines have no blanks at their ends."""
    return F.regexp_replace(text, r"(?md)^[ \t\x0B\f\r]++|(?<![ \t\x0B\f\r])[ \t\x0B\f\r]++$", "")


def shape(text: Column) -> Column:
    """A text with its words and numbers as classes; lines and indentation are kept."""
    s = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"(?<![0-9A-Za-z])[A-Za-z]++(?![0-9])", "a")  # in steps that each take one pass, also over a word of any length
    s = F.regexp_replace(s, r"(?<![0-9A-Za-z])(?!a(?![0-9A-Za-z]))[0-9A-Za-z]++", "9")
    return F.regexp_replace(F.regexp_replace(s, r"\p{L}[\p{L}\p{M}]*", "a"), r"9(?:\.9)+", "9")


def limits(t: DataFrame) -> DataFrame:
    """Lengths at which distinct texts of a source pile up: source, unit (chars or octets), at, n. t: one row for each distinct text. Texts are counted per source and length first, so the table is small."""
    per = t.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("at")), F.struct(F.lit("octets").alias("unit"), F.col("octets").alias("at")))).alias("x"))
    count = per.groupBy("source", "x.unit", "x.at").agg(F.count("*").alias("n"))
    spread = count.select("source", "unit", "n", "at", F.explode(F.sequence(F.col("at") - AROUND, F.col("at") + AROUND)).alias("to"))
    own = F.sum(F.when(F.col("to") == F.col("at"), F.col("n")).otherwise(0))
    both = spread.groupBy("source", "unit", "to").agg(own.alias("n"), (F.sum("n") - own).alias("around"))
    return both.filter((F.col("n") >= PILE) & (F.col("n") > PILE_RATIO * F.col("around") / (2 * AROUND) + PILE / 2)).select("source", "unit", F.col("to").alias("at"), "n")


def closing_lines(texts: DataFrame) -> DataFrame:
    """How often lines and their shapes close a line: key (as in tails), closed_in (texts in which a line break follows). Only hashes are shuffled, combined within each partition. Shapes of sentences aren't counted."""
    d = texts.select(F.split(clean_lines(F.col("text")), "\n").alias("c"), F.split(shape(F.col("text")), "\n").alias("s"))
    inner = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)  # those that a line break follows
    lines = F.transform(F.filter(inner("c"), lambda x: x != ""), lambda x: F.xxhash64(F.lit("l"), x))
    shapes = F.zip_with(inner("c"), inner("s"), lambda c, s: F.when((c != "") & ~F.right(c, F.lit(1)).isin(*".。!?"), F.xxhash64(F.lit("s"), s)))
    return d.select(F.explode(F.array_distinct(F.concat(lines, F.filter(shapes, lambda x: x.isNotNull())))).alias("key")).groupBy("key").agg(F.count("*").alias("closed_in"))


def going_on(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often lines go on after the wanted ones (column line): line_key, goes_on (distinct longer lines of each text that begin with it).

    Only prefixes of a length that a wanted line with the same first characters has are made, and only their hashes are shuffled."""
    lengths = wanted.groupBy(F.substring("line", 1, 3).alias("lead")).agg(F.collect_set(F.length("line")).alias("ats"))
    lines = texts.select(F.explode(F.array_distinct(F.filter(F.split(clean_lines(F.col("text")), "\n"), lambda x: x != ""))).alias("text_line"))
    lead = lambda n: F.substring("text_line", 1, n)
    led = lines.withColumn("lead", F.explode(F.array_distinct(F.array(lead(1), lead(2), lead(3))))).join(bounded_broadcast(lengths), "lead")
    keys = F.transform(F.filter("ats", lambda n: n < F.length("text_line")), lambda n: F.xxhash64(F.lit("l"), F.expr("text_line").substr(F.lit(1), n)))
    begun = led.select(F.explode(keys).alias("line_key")).groupBy("line_key").agg(F.count("*").alias("goes_on"))
    return begun.join(wanted.select("line_key"), "line_key", "left_semi")


def trie_nodes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes of the vocabulary's trie that the wanted tokens (column token) reach: token, word_in (texts that have it as a word), below (longer words of several texts), below_any (of any).

    A word counts where something follows it, so that the cut ends themselves teach nothing. No prefix is made that is longer than every wanted token."""
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    ended = F.regexp_like(F.right(_core(F.col("text")), F.lit(1)), F.lit(r"\p{L}"))
    words = F.when(ended, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    df = texts.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    longest = wanted.agg(F.coalesce(F.max(F.length("token")), F.lit(0)).alias("longest"))  # one row
    made = df.crossJoin(F.broadcast(longest)).filter("longest > 0").withColumn("n", F.length("word"))
    nodes = made.select("df", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least("n", "longest")), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("token"))
    longer = F.length("token") < F.col("n")
    per = nodes.groupBy("token").agg(F.sum(F.when(~longer, F.col("df"))).alias("word_in"), F.count_if(longer & (F.col("df") > 1)).alias("below"), F.count_if(longer).alias("below_any"))
    return per.join(wanted.select("token").distinct(), "token", "left_semi")


def judged(docs: DataFrame) -> DataFrame:
    """Every text that isn't blank with the evidence: doc_id, source, cut, why."""
    t = cut(tails(docs))  # the ends, without the texts
    first = t.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    one = t.join(first.select("doc_id"), "doc_id", "left_semi")  # of every distinct text
    texts = docs.join(bounded_broadcast(t.select("doc_id").join(first.select("doc_id"), "doc_id", "left_anti")), "doc_id", "left_anti").filter(F.col("text").isNotNull()).select("text")
    asks = ~F.col("sentence") | F.col("dots") | F.col("mark")
    ask = one.filter(asks)
    keys = ask.select(F.explode(F.array("line_key", "shape_key")).alias("key")).distinct()
    seen = cut(closing_lines(texts).join(keys, "key", "left_semi"))
    trie = trie_nodes(texts, ask.filter(F.col("token") != "").select("token"))
    final = ask.filter(~F.col("closed")).groupBy("line_key").agg(F.count("*").alias("ends"), F.min("line").alias("line"))
    closes = seen.select(F.col("key").alias("line_key"), "closed_in")
    weighed = final.join(closes, "line_key", "left").filter((F.col("ends") >= KNOWN) | F.col("closed_in").isNotNull()).select("line_key", "line")
    ending = final.join(going_on(texts, weighed), "line_key", "left").select(F.col("line_key").alias("lk"), "ends", "goes_on")
    lim = limits(one)
    at_chars = lim.filter("unit = 'chars'").select(F.col("source").alias("cs"), F.col("at").alias("ca"))
    at_octets = lim.filter("unit = 'octets'").select(F.col("source").alias("os"), F.explode(F.array("at", F.col("at") - 1, F.col("at") - 2)).alias("oa")).distinct()
    none = F.xxhash64(F.lit("none"), "doc_id")  # ends that ask nothing meet no row, and not in one task
    x = (
        t.withColumn("lk", F.when(asks, F.col("line_key")).otherwise(none))
        .withColumn("sk", F.when(asks, F.col("shape_key")).otherwise(none))
        .withColumn("tk", F.when(asks & (F.col("token") != ""), F.col("token")).otherwise(none.cast("string")))
        .join(seen.select(F.col("key").alias("lk"), F.col("closed_in").alias("line_in")), "lk", "left")
        .join(ending, "lk", "left")
        .join(seen.select(F.col("key").alias("sk"), F.col("closed_in").alias("shape_in")), "sk", "left")
        .join(trie.withColumnRenamed("token", "tk"), "tk", "left")
    )
    x = x.join(at_chars, F.col("source").eqNullSafe(F.col("cs")) & (F.col("chars") == F.col("ca")), "left").join(at_octets, F.col("source").eqNullSafe(F.col("os")) & (F.col("octets") == F.col("oa")), "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    closing = z("line_in") - F.col("closed").cast("int")  # in other texts
    closed = (closing > 0) & (closing >= CLOSED_SHARE * (closing + z("ends"))) & (z("goes_on") < GOES_ON * closing)
    line_known = closed | (z("ends") >= KNOWN) & (z("goes_on") < z("ends"))
    at_limit = F.col("ca").isNotNull() | F.col("oa").isNotNull()
    # At a source's limit one longer word is enough; elsewhere the longer words must stand in several texts.
    half_word = (F.col("token") != "") & (z("word_in") == 0) & F.when(at_limit, z("below_any") > 0).otherwise(z("below") > 0)
    plain_end = ~F.col("sentence") & ~F.col("closed") & ~F.col("dots")
    why = (
        F.when(F.col("mark"), "marked")
        .when(F.col("dots") & ~closed, "dots")
        .when(F.col("dots"), F.lit(None))
        .when(F.col("json_cut") & ~F.col("closed"), "record")
        .when(plain_end & half_word, "half_word")
        .when(line_known & ~at_limit, F.lit(None))
        .when(at_limit & (plain_end | F.col("open_point")) & (z("shape_in") < KNOWN), "limit")
        .when(plain_end & (z("shape_in") < KNOWN), "line")
        .when(F.col("fence_open") & ~F.col("closed"), "fence")
    )
    return x.select("doc_id", "source", why.alias("why")).withColumn("cut", F.col("why").isNotNull())
