"""Quality rules, line first.

Rules run on each line: it must have a word, end in closing punctuation, not be
mostly symbols, not be shouted, and not be navigation or boilerplate.  Those two
are told by figures that hold in any language: separators between entries
(bars, arrows, dots, or single-sided guillemets), links, and in short lines the
share of words that begin with a capital.  Set phrases of site furniture in
four languages count in short lines only, so prose that speaks of cookies
stays.  Lines that fail are removed; a document is rejected when
the removed lines hold more than ``MAX_LOST_PERCENT`` of its word characters,
or when it fails the base rules on its whole text (too few words, too many
words in repeated 5-word windows).

DataFrame functions only, and no shuffle: every figure comes from the row's own
text.  Windows found twice are told by sorting their 64-bit hashes within the
row; texts without a repeated window skip that sort.

Cases: null text has no words and counts as the empty text (base failed); a
null id or a repeated row is judged like any other; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the rules
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]"
GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CLOSING = r"[.!?:;,\"')\]}»”’…][\x20\x09-\x0D]*$"
SEPARATORS = "|>›→·•"  # » too, where no « opens a quotation
LINK = r"(?i)https?://|www[.]|[]][(]"
CAPITAL = r"(^|[\x20\x09-\x0D])[A-ZÀ-ÖØ-Þ]"
BOILERPLATE = (r"(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|subscribe|newsletter"
               r"|sign (up|in)|log ?in|click here|read more|javascript|lorem ipsum"
               r"|tous droits r.serv|mentions l.gales|politique de confidentialit|se connecter|lire la suite|plan du site"
               r"|alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|weiterlesen|jetzt anmelden"
               r"|todos los derechos reservados|pol.tica de privacidad|aviso legal|iniciar sesi.n|leer m.s|mapa del sitio)")
SHORT_CHARS = 200
MIN_CAPITAL_WORDS = 4
CAPITAL_PERCENT = 80
MAX_LINKS = 1
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
SHOUTED_CHARS = 20


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def good_line(line: Column) -> Column:
    """Whether a line with a word passes every rule."""
    solid = F.length(without(line, SPACES))
    symbols = F.length(line) - F.length(without(line, SYMBOLS))
    shouted = (solid >= SHOUTED_CHARS) & line.rlike("[A-Z]") & ~line.rlike("[a-zß-öø-ÿ]")
    return line.rlike(CLOSING) & (symbols * 10 <= solid) & ~navigation(line) & ~shouted & ~furniture(line)


def navigation(line: Column) -> Column:
    """Whether a line lists entries: separators between them, or links."""
    separators = F.length(line) - F.length(without(line, SEPARATORS))
    closing = F.when(~line.contains("«"), F.length(line) - F.length(without(line, "»"))).otherwise(0)
    links = F.when(line.contains("://") | line.contains("www.") | line.contains("]("), F.regexp_count(line, F.lit(LINK))).otherwise(0)
    return (separators + closing >= 2) | (links > MAX_LINKS)


def furniture(line: Column) -> Column:
    """Whether a short line is a title or a set phrase of a site."""
    words = F.regexp_count(line, F.lit(WORD + "+"))
    capitals = F.regexp_count(line, F.lit(CAPITAL))
    titled = (words >= MIN_CAPITAL_WORDS) & (capitals * 100 >= words * CAPITAL_PERCENT)
    return (F.length(line) < SHORT_CHARS) & (titled | line.rlike(BOILERPLATE))


def window_hashes(words: Column) -> Column:
    """Hash of every window of words; none for a short array."""
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(hashes)


def sorted_windows(hashes: Column) -> Column:
    """``(hash, place)`` in order of hash, only where a hash repeats."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def repeat_words(pairs: Column) -> Column:
    """Words lying in a window that occurs twice or more.  ``pairs`` must be a
    column, not an expression, for it is looked up once a place."""
    def again(p: Column, k: Column) -> Column:
        before = (k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])
        after = (k < F.size(pairs) - 1) & (F.get(pairs, k + 1)["h"] == p["h"])
        return F.when(before | after, p["i"])

    places = F.array_sort(F.filter(F.transform(pairs, again), lambda p: p.isNotNull()))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
                          lambda a: a["n"])
    return F.coalesce(covered, F.lit(0))


def judge_lines(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_bad_lines, kept_chars, kept_text)``:
    the figures, the verdict and the text left after cleaning."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", F.filter(F.split("text", GAPS), lambda w: w != "").alias("words"),
                       F.filter(F.split("text", "\n"), lambda li: li.rlike(WORD)).alias("lines"))
    # each step is a column of its own, so it is worked out once a row
    rows = rows.select("doc_id", "text", "lines", F.size("words").cast("long").alias("n_words"),
                       window_hashes(F.col("words")).alias("hashes"), F.filter("lines", good_line).alias("good"))
    rows = rows.select("doc_id", "text", "lines", "n_words", "good", sorted_windows(F.col("hashes")).alias("pairs"))
    rows = rows.select("doc_id", "text", "lines", "n_words", "good", repeat_words(F.col("pairs")).cast("long").alias("n_repeat_words"))
    rows = rows.select("doc_id", "n_words", F.length(without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
                       (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       "n_repeat_words", (F.size("lines") - F.size("good")).cast("long").alias("n_bad_lines"),
                       F.array_join("good", "\n").alias("kept_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.length(without(F.col("kept_text"), SPACES)).cast("long")
    rows = rows.select("*", failed.alias("base_failed"), left.alias("kept_chars"))
    lost = (F.col("word_chars") - F.col("kept_chars")) * 100 > F.col("word_chars") * max_lost_percent
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & ~lost).alias("kept"), "n_bad_lines", "kept_chars", "kept_text")
