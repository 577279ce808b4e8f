"""Text functions as columns: normalising, tokens, identifiers, cleaning, markers and rendering."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no weight in retrieval.
STOP_WORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 它 他 她 与 及 或 但 而 且 则 于 以 对 为 由 把 被 让 使 "
    "其 此 该 那些 这些 什么 怎么 如何 为什么 哪些 哪种 哪类 几个 多少 哪里 哪儿 何时 可以 可能 应该 "
    "the a an is are was were be been being and or but if of at by for with in on to from this that these those"
).split()
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


#: A pattern of the characters that NFKC leaves alone whatever stands beside them, or that normalize() maps itself: texts of these alone need no NFKC.
_STABLE = [chr(c) for c in (*range(0x180), *range(0x2010, 0x2028), *range(0x3001, 0x3030)) if unicodedata.normalize("NFKC", chr(c)) == chr(c)]


def _ranges(chars: list[str]) -> str:
    """Characters in order of their code points as ranges of a pattern's class."""
    codes = [ord(c) for c in chars]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True))


_PLAIN = _ranges(_STABLE) + "一-鿿㐀-䶿　！-～"


def normalize(text: Column) -> Column:
    """NFKC and lower case. Full-width forms become ASCII by translation; only texts with other compatibility or combining characters go through Python."""
    plain = F.lower(F.translate(text, _WIDE, _NARROW))
    odd = text.rlike(r"[^\x00-\x9f\xbf-\x{131}]") & text.rlike(f"[^{_PLAIN}]")  # the first test is fast and lets most texts through
    return F.when(odd, normalize_nfkc(F.when(odd, text))).otherwise(plain)


def normalize_nfkc(text: Column) -> Column:
    """NFKC and lower case of every text."""

    @F.pandas_udf(StringType())
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())

    return nfkc(text)


def _words(normal: Column, stop: list[str], segment: Callable[[Column], Column] | None = None) -> Column:
    if segment is not None:
        runs = segment(F.regexp_extract_all(normal, F.lit(r"[一-鿿㐀-䶿]+|[\p{L}&&[^一-鿿㐀-䶿]]+|\p{N}+"), F.lit(0)))
        return F.filter(runs, lambda w: ~w.isin(stop))
    words = F.regexp_extract_all(normal, F.lit(r"[一-鿿㐀-䶿]|[\p{L}&&[^一-鿿㐀-䶿]]+|\p{N}+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop))


def word_run(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Words of a text in order, repeats included: letter runs, digit runs, single CJK characters; stop words left out."""
    return _words(normalize(text), stop)


def _cjk_pairs(normal: Column, stop: list[str]) -> Column:
    pairs = F.filter(F.regexp_extract_all(normal, F.lit(r"(?=([一-鿿㐀-䶿]{2}))"), F.lit(1)), lambda w: ~w.isin(stop))
    return F.when(normal.rlike("[一-鿿㐀-䶿]{2}"), pairs).otherwise(F.array().cast("array<string>"))


def token_parts(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """struct(words, pairs): the words of a text in order and its CJK pairs, repeats included; with the words' neighbours these tell tokens()."""
    return F.get(F.transform(F.array(normalize(text)), lambda t: F.struct(_words(t, stop).alias("words"), _cjk_pairs(t, stop).alias("pairs"))), F.lit(0))


def tokens_of(words: Column, pairs: Column) -> Column:
    """tokens() of a text of which these are the parts."""
    return F.array_distinct(F.concat(words, pairs, _joined(words)))


def _joined(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b))


def tokens(text: Column, stop: list[str] = STOP_WORDS, segment: Callable[[Column], Column] | None = None) -> Column:
    """Distinct words in order, CJK pairs, then neighbouring words joined by an underscore.

    segment: how runs of letters or CJK characters are cut into words (functions.segment); without it each run of letters and each CJK character is a word."""

    def of(normal: Column, words: Column) -> Column:
        return tokens_of(words, _cjk_pairs(normal, stop))

    # Arrays of one element name the normal text and its words, so that each is worked out once.
    if segment is None:
        one = F.transform(F.array(normalize(text)), lambda t: F.struct(t.alias("normal"), _words(t, stop).alias("words")))
    else:  # a batch function cannot stand in a lambda
        normal = normalize(text)
        one = F.array(F.struct(normal.alias("normal"), _words(normal, stop, segment).alias("words")))
    return F.when(text.isNotNull(), F.get(F.transform(one, lambda x: of(x.normal, x.words)), F.lit(0)))


def estimate_tokens(text: Column) -> Column:
    return F.coalesce(F.floor(F.length(text) / 2), F.lit(0)).cast("long")


def budget_tokens(text: Column) -> Column:
    return F.coalesce(F.floor(F.length(text) * 1.2), F.lit(0)).cast("long")


def cut_to_tokens(text: Column, most: int) -> Column:
    return F.substring(text, 1, int(most / 1.2))


def content_id(text: Column) -> Column:
    """The first 32 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 32)


def query_hash(query: Column) -> Column:
    return F.sha2(F.lower(F.trim(query)), 256)


def compress(text: Column, most: int) -> Column:
    """Over most characters the first and last half of them remain."""
    if most <= 0:
        return text
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


# LaTeX commands and their signs, in the order of replacement.
LATEX = [("\\times", "×"), ("\\div", "÷"), ("\\approx", "≈"), ("\\leq", "≤"), ("\\le", "≤"), ("\\geq", "≥"), ("\\ge", "≥"), ("\\neq", "≠"), ("\\equiv", "≡"), ("\\pm", "±"), ("\\cdot", "·")]


def plain_math(text: Column) -> Column:
    """LaTeX as plain text."""
    for pattern in (r"(?s)\$\$(.*?)\$\$", r"(?s)\$(.*?)\$"):
        text = F.regexp_replace(text, pattern, "$1")
    for command, sign in LATEX:
        text = F.replace(text, F.lit(command), F.lit(sign))
    for pattern in (r"(?s)\\mathbf\{(.*?)\}", r"(?s)\\text\{(.*?)\}"):
        text = F.regexp_replace(text, pattern, "$1")
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit("\n")), F.lit("  "), F.lit(" "))


# Citations -------------------------------------------------------------------------------------------------------------

def citations(text: Column) -> Column:
    """Numbers of [n] markers of one to three digits, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda n: n.cast("int")))


def valid_citations(text: Column, n_sources: Column) -> Column:
    return F.filter(citations(text), lambda n: (n >= 1) & (n <= n_sources))


def invalid_citations(text: Column, n_sources: Column) -> Column:
    return F.filter(citations(text), lambda n: (n < 1) | (n > n_sources))


def drop_citations(text: Column, wrong: Column) -> Column:
    """text without the markers of the numbers in wrong."""
    return F.aggregate(wrong, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"\[0*"), n.cast("string"), F.lit(r"\]")), F.lit("")))


def substantive(text: Column, least: int = 20) -> Column:
    """At least so many characters besides markers, blanks, punctuation and brackets."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[\d{1,3}\]", ""), r"\s+", "")
    return F.length(F.coalesce(F.regexp_replace(bare, r"""[，。！？、；：“”‘’"'（）()【】,.!?;:—\[\]-]""", ""), F.lit(""))) >= least


def citation_warning(text: Column, n_sources: Column) -> Column:
    """Whether a substantive text has sources but cites none of them."""
    return substantive(text) & (n_sources > 0) & (F.size(valid_citations(text, n_sources)) == 0)


# Cleaning --------------------------------------------------------------------------------------------------------------

# Labels of remembered facts.
MEMORY_LABELS = ["偏好", "身份", "事实", "主题", "用户偏好", "关键事实", "关注主题", "未解决问题"]


def drop_labels(text: Column, labels: list[str] = MEMORY_LABELS) -> Column:
    return F.trim(F.replace(F.regexp_replace(text, r"\s*\[(" + "|".join(labels) + r")\]", ""), F.lit("  "), F.lit(" ")))


def clean_symbols(text: Column) -> Column:
    """Without geometric signs and blanks between CJK characters; runs of three blanks or more become one."""
    text = F.regexp_replace(text, r"[■-◿☀-➿⬀-⯿]", "")
    text = F.regexp_replace(text, r"(?<=[一-鿿])\s+(?=[一-鿿])", "")
    return F.regexp_replace(text, r"[ \t]{3,}", " ")


# Signs that end a paragraph, signs that no line begins with, and marks of lists and titles.
PARAGRAPH_ENDS = "。！？；：…」』）】》"
NO_LINE_START = "、，。！？；：…」』）】》"
LIST_MARKS = [
    r"\d+[.、）)]", r"[（(]\d+[）)]", r"[一二三四五六七八九十]+[、.）)]", r"第[一二三四五六七八九十百千]+[章节条]", "●|•|◆|■|★|☆", r"[【\[《「『]", r"#{1,6}\s",
]

#: What the seam of two lines looks like, and whether its break stays; the first that fits decides, and no fit joins the lines.
SEAMS = [
    (rf"[{PARAGRAPH_ENDS}]\n", True),
    (r"[\x00-\x7F][.!?;]\n", True),
    (rf"\n(?:{'|'.join(LIST_MARKS)})", True),
    (rf"\n[{NO_LINE_START}]", False),
    (r"\n(?=.*[A-Z])[\x00-\x60\x7B-\x7F]{4,}$", True),  # capitals
    (rf"^.{{1,19}}\n[^{NO_LINE_START}]{{1,19}}$", True),  # two short lines
]


def join_lines(text: Column) -> Column:
    """Lines that are broken for the eye alone are joined; paragraphs, lists, titles and sentence ends keep their breaks. A fold over the lines."""

    def step(done: Column, line: Column) -> Column:
        own, open_ = F.trim(line), F.coalesce(F.get(done, F.size(done) - 1), F.lit(""))
        seam = F.concat(open_, F.lit("\n"), own)
        stays = F.lit(False)
        for pattern, keep in reversed(SEAMS):
            stays = F.when(seam.rlike(pattern), F.lit(keep)).otherwise(stays)
        glue = F.when(seam.rlike(r"[\x00-\x7F]\n|\n[\x00-\x7F]"), F.lit(" ")).otherwise(F.lit(""))
        joined = F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), F.concat(open_, glue, own))
        return F.when((own == "") | (open_ == "") | stays, F.array_append(done, own)).otherwise(joined)

    tidy = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n")
    lines = F.aggregate(F.split(tidy, "\n"), F.array().cast("array<string>"), step)
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def clean_ocr(text: Column) -> Column:
    return F.when(F.trim(text) == "", text).otherwise(join_lines(clean_symbols(text)))


def drop_matching_lines(text: Column, entries: Column) -> Column:
    """text without lines that equal an entry, or that begin or end with one of four characters or more and are at most five longer."""
    bare = lambda s: F.regexp_replace(s, r"\s+", "")
    hit = lambda line: F.exists(entries, lambda e: (bare(line) == e) | ((F.length(e) >= 4) & (F.startswith(bare(line), e) | F.endswith(bare(line), e)) & (F.length(bare(line)) - F.length(e) <= 5)))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: (bare(line) == "") | ~hit(line)), "\n")


def grounded(sentences: Column, mark: str = " [ungrounded]") -> Column:
    """An array of (text, grounded) as one text in which ungrounded sentences bear a mark."""
    return F.array_join(F.transform(sentences, lambda s: F.when(s.grounded, s.text).otherwise(F.concat(s.text, F.lit(mark)))), "")


def highlight(text: Column, keyword: Column, width: int = 200, left: str = "**", right: str = "**") -> Column:
    """The first characters on one line, with each occurrence of the keyword marked."""
    preview = F.replace(F.substring(text, 1, width), F.lit("\n"), F.lit(" "))
    return F.when(keyword == "", preview).otherwise(F.replace(preview, keyword, F.concat(F.lit(left), keyword, F.lit(right))))


def safe_name(name: Column, default: str = "default") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(name), r"[^\w一-鿿-]", "_"), F.lit("")), F.lit(default))


def activity_time(text: Column, year: Column) -> Column:
    """A full timestamp, else month and day with the year given."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(F.concat(year.cast("string"), F.lit("-"), text), F.lit("yyyy-MM-dd HH:mm")))


def inject_title(content: Column, title: Column) -> Column:
    """A table line that begins with [x] gets the document's title once."""
    return F.when(~F.contains(content, F.concat(F.lit("doc="), title)), F.regexp_replace(content, F.lit(r"^(\[[^\]]+\])\s+"), F.concat(F.lit("$1 doc="), F.regexp_replace(title, r"([\\$])", r"\\$1"), F.lit(" | ")))).otherwise(content)
