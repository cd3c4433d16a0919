"""Text as columns: tokens, sentences, sets and their overlaps, Vietnamese legal citations and question types."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)\s+"
#: What ``\s`` stands for in these expressions: the characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: ``str.split`` parts at these too.
_OTHER = re.compile("[\x1c-\x1f]")
_RUN = re.compile(f"[{SPACES}]+")

# --- fixed values: what results depend on -------------------------------------------------------------------------------
NOISE = ("Bạn phải đăng nhập hoặc đăng ký Thành Viên TVPL Pro",)
STOPWORDS = ("ai", "bao", "các", "có", "của", "được", "gì", "hay", "không", "là", "một", "nào", "những", "phải", "theo", "thế", "thì", "trong", "và", "về")
CONTENT_WORD = "[0-9a-zA-ZÀ-ỹĐđ]+"
LEGAL_ID = r"(?iU)\b\d{1,4}/\d{4}/(?:NĐ-CP|QH\d+|QĐ-[A-ZĐ]+|TT-[A-ZĐ]+|TTLT-[A-ZĐ-]+|NQ-[A-ZĐ]+|CP|UBTVQH\d+|HĐTP)\b"
ARTICLE = r"(?iU)\bĐiều\s+\d+[a-zA-ZđĐ]?\b"
CLAUSE = r"(?iU)\bkhoản\s+\d+[a-zA-ZđĐ]?\b"
POINT = r"(?iU)\bđiểm\s+[a-zA-ZđĐ]\b"
NAMED_DOCUMENT = r"(?iU)\b(?:Bộ luật|Luật)\s+[^,:;\n]{2,100}?\s+(?:19|20)\d{2}\b"
DOCUMENT_NUMBER = r"(?i)S[ốôo]\s*:?[\s\r\n]*([0-9]+[A-Za-z0-9\-/ĐđƯưƠơ]*)"
AMOUNT = r"(?iU)\b\d+(?:[.,]\d+)?\s*(?:ngày|tháng|năm|giờ|phút|%|phần trăm)\b"
LIST_ITEM = r"(?imU)^\s*(?:[-–•]|\(?\d+[.)]|\(?[a-zđ][.)])\s+"
VAGUE = r"(?iU)\b(?:nêu trên|như trên|quy định trên|theo quy định nêu trên|các nội dung trên)\b"
NEGATIVE = r"(?iU)\b(?:không được|không phải|không cần|không bắt buộc|bị cấm|không đủ)\b"
POSITIVE = r"(?iU)\b(?:được|phải|cần|bắt buộc|có thể)\b"
QUESTION_TYPES = (
    ("subject", r"(?U)\b(ai|đối tượng nào|chủ thể nào|người nào)\b"),
    ("rights_and_duties", r"(?U)(?<!thẩm\s)\b(?:quyền(?:\s+lợi)?|nghĩa vụ|trách nhiệm)\b"),
    ("number_or_time", "bao nhiêu|mức |thời hạn|thời gian|tỷ lệ|số lượng"),
    ("condition", "khi nào|trường hợp nào|điều kiện"),
    (
        "procedure_or_list",
        "trình tự|thủ tục|như thế nào|gồm những gì|bao gồm|gồm những (?:nội dung|mục|bước|thành phần|loại) nào"
        "|những (?:nội dung|vấn đề|giấy tờ|hồ sơ|tài liệu) (?:gì|nào)|cần (?:chuẩn bị )?những (?:giấy tờ|hồ sơ|tài liệu) nào",
    ),
    ("yes_no", r"có được|được phép|có phải|hay không|không\?"),
)
# ------------------------------------------------------------------------------------------------------------------------


def let(value: Column, use) -> Column:
    """use(value) with value computed once: what stands inside a lambda is otherwise computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def rstrip_at(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def tokens(c: Column) -> Column:
    """White-space tokens; none for a blank or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WS), lambda x: x != "")


def split_space(text: str) -> list[str]:
    """``tokens`` of a Python string."""
    return [w for w in _RUN.split(text) if w] if _OTHER.search(text) else text.split()


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(F.lower(c)))


def squeeze(c: Column) -> Column:
    """One space between tokens, none at the ends."""
    return F.array_join(tokens(c), " ")


def dedup_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def content_tokens(c: Column) -> Column:
    words = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({CONTENT_WORD})"), F.lit(1)), F.lower)
    return F.array_except(F.filter(words, lambda w: F.length(w) > 1), F.array(*map(F.lit, STOPWORDS)))


def sentences(c: Column) -> Column:
    """Parts after a full stop, question mark or exclamation mark and white space, without blank ones."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.?!])\s+"), strip), lambda x: x != "")


def split_units(c: Column) -> Column:
    """Paragraphs; where there is only one, parts after full stops and semicolons; where there is one of these, the text."""
    def clean(parts: Column) -> Column:
        return F.filter(F.transform(parts, strip), lambda x: x != "")

    paragraphs, clauses = clean(F.split(c, "\n\n+")), clean(F.split(c, r"(?U)(?<=[.;])\s+"))
    return F.when(F.size(paragraphs) > 1, paragraphs).when(F.size(clauses) > 1, clauses).otherwise(F.array(strip(c)))


def query_variants(c: Column) -> Column:
    """The distinct ones of: the text, its longest (first of equals), first and last sentence."""
    def variants(s: Column) -> Column:
        return F.when(F.size(s) > 1, F.array_distinct(F.array(strip(c), longest(s), F.element_at(s, 1), F.element_at(s, -1)))).otherwise(F.array(strip(c)))

    return let(sentences(c), variants)


def longest(parts: Column) -> Column:
    """The longest string of an array, the first of equals; empty for none."""
    return F.aggregate(parts, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    def share(n: Column) -> Column:
        union = F.size(a) + F.size(b) - n
        return F.when(union > 0, n / union).otherwise(F.lit(0.0))

    return let(overlap(a, b), share)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Tokens of a that b holds, each as often as b has it."""
    def times(x: Column, t: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == t))

    def total(p: Column) -> Column:
        shared = F.array_intersect(p["a"], p["b"])
        return F.aggregate(F.transform(shared, lambda t: F.least(times(p["a"], t), times(p["b"], t))), F.lit(0), lambda n, x: n + x)

    return let(F.struct(a.alias("a"), b.alias("b")), total)


def coverage(gold: Column, candidate: Column) -> Column:
    """Share of gold's tokens, repeats included, that are among the candidate's tokens."""
    return let(F.struct(gold.alias("g"), candidate.alias("c")), lambda p: let(F.struct(p["g"].alias("g"), F.array_except(p["g"], p["c"]).alias("m")), _covered))


def _covered(p: Column) -> Column:
    hit = F.size(F.filter(p["g"], lambda t: ~F.array_contains(p["m"], t)))
    return F.when(F.size(p["g"]) > 0, hit / F.size(p["g"])).otherwise(F.lit(0.0))


def set_f1(gold: Column, candidate: Column) -> Column:
    n = F.size(gold) + F.size(candidate)
    return F.when(n > 0, 2 * overlap(gold, candidate) / n).otherwise(F.lit(0.0))


def set_precision(gold: Column, candidate: Column) -> Column:
    """Share of the candidate's set that the gold set holds; 0 for an empty one."""
    return F.when(F.size(candidate) > 0, overlap(gold, candidate) / F.size(candidate)).otherwise(F.lit(0.0))


def set_recall(gold: Column, candidate: Column) -> Column:
    """Share of the gold set that the candidate's set holds; 0 for an empty one."""
    return set_precision(candidate, gold)


def repeated_ngrams(words: Column, n: int = 4) -> Column:
    """1 - distinct / all n-grams; 0 where there is none."""
    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, let(each, lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g))).otherwise(F.lit(0.0))

    return let(words, grams)


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def ordered_unique(values: Column) -> Column:
    """Values with white space squeezed, the first of those equal but for case, in order."""
    def once(p: Column) -> Column:
        return let(F.transform(p, F.lower), lambda low: F.filter(p, lambda x, i: F.array_position(low, F.lower(x)) == i + 1))

    return let(F.transform(values, squeeze), once)


def citations(c: Column) -> Column:
    """struct<document_numbers, named_documents, articles, clauses, points> of ordered distinct citations."""
    parts = {"document_numbers": LEGAL_ID, "named_documents": NAMED_DOCUMENT, "articles": ARTICLE, "clauses": CLAUSE, "points": POINT}
    return F.struct(*[ordered_unique(all_matches(c, p)).alias(k) for k, p in parts.items()])


def citation_signature(answer: Column, sample_id: Column) -> Column:
    """Sorted citations of the first line, or ungrouped:id where it cites neither a document nor an article."""
    line = F.element_at(F.split(normal_newlines(answer), "\n"), 1)
    laws = F.array_sort(F.array_distinct(F.transform(all_matches(line, LEGAL_ID), F.upper)))
    articles, clauses = (F.array_sort(F.array_distinct(F.transform(all_matches(line, p), F.lower))) for p in (ARTICLE, CLAUSE))
    return F.when(F.size(laws) + F.size(articles) > 0, F.array_join(F.concat(laws, articles, clauses), "|")).otherwise(F.concat(F.lit("ungrouped:"), sample_id))


def question_type(c: Column) -> Column:
    low = dedup_key(c)
    out = F.lit("other")
    for kind, pattern in reversed(QUESTION_TYPES):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return out


def normal_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\r\n?", "\n"))


def amounts(c: Column) -> Column:
    return F.array_distinct(F.transform(all_matches(c, AMOUNT), dedup_key))


def list_items(c: Column) -> Column:
    return F.size(all_matches(c, LIST_ITEM))


def polarity(c: Column) -> Column:
    """negative, positive, or null where both or neither are found."""
    negative = c.rlike(NEGATIVE)
    positive = F.regexp_replace(c, NEGATIVE, " ").rlike(POSITIVE)
    return F.when(negative & ~positive, "negative").when(positive & ~negative, "positive")


def clean_passage(c: Column, noise: tuple[str, ...] = NOISE) -> Column:
    """Each known noise string becomes a space."""
    for n in noise:
        c = F.replace(c, F.lit(n), F.lit(" "))
    return c


def name_from_link(link: Column) -> Column:
    """Last segment of a URL without .aspx; unknown where there is none."""
    last = F.element_at(F.split(F.regexp_replace(F.coalesce(link, F.lit("")), "/+$", ""), "/"), -1)
    name = F.regexp_replace(last, r"\.aspx$", "")
    return F.when(name == "", "unknown").otherwise(name)


def document_number(passage: Column, head: int = 400) -> Column:
    """The document number in the first characters, upper case without white space; null where there is none."""
    found = F.regexp_extract(F.substring(passage, 1, head), DOCUMENT_NUMBER, 1)
    number = F.upper(F.regexp_replace(F.regexp_replace(found, "[.,;]+$", ""), WS, ""))
    return F.when(number != "", number)


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def nfc(c: Column) -> Column:
    """Unicode composition; an Arrow function, for the JVM has no such column function."""

    @F.pandas_udf("string")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return udf(c)


def segmented(c: Column, segment=None, cap: int | None = None) -> Column:
    """Tokens by a pluggable segmenter (a column function; by default lower-cased white-space tokens), of the first cap characters if one is given."""
    text = F.substring(c, 1, cap) if cap else c
    return segment(text) if segment else tokens(F.lower(text))
