"""Text rules as Spark column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COMMIT_EVENTS, INTENT_WORDS, STOP_WORDS

PREDICATES = (("STORES_IN", r"stores\s+data\s+in"), ("DEPENDS_ON", r"depends\s+on"), ("USES", "uses"), ("CALLS", "calls"))
#: Of each predicate's words, one that a statement must hold.
FACT_WORDS = ("stores", "depends", "uses", "calls")


def sha_key(prefix: str, *parts: Column | str, sep: str = ":") -> Column:
    """prefix followed by the hex SHA-256 of the parts with a separator."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(sep, *parts), 256))


#: Unicode's white space, which ``(?U)\\s`` matches; trimming by a set of characters takes a small part of the time of a regular expression.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def squeeze(text: Column) -> Column:
    """Trimmed of white space."""
    return F.btrim(text, F.lit(WHITE))


def once(text: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(text), with text evaluated once however often the rule names it."""
    return F.transform(F.array(text), rule)[0]


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds any of some words."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def title_case(text: Column) -> Column:
    """Upper-cases the first character of each word, keeps the rest, joins words by one blank."""
    words = F.split(squeeze(text), r"(?U)\s+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def commit_event(title: Column) -> Column:
    """The event a conventional commit title stands for, else null."""
    kind = F.lower(squeeze(F.substring_index(squeeze(F.substring_index(title, ":", 1)), "(", 1)))
    events = F.create_map(*[F.lit(x) for pair in COMMIT_EVENTS.items() for x in pair])
    return F.when(F.instr(title, ":") > 0, F.try_element_at(events, kind))


def commit_title(title: Column) -> Column:
    """What follows the first colon (or all of it), title-cased."""
    rest = F.when(F.instr(title, ":") > 0, title.substr(F.instr(title, ":") + 1, F.length(title))).otherwise(title)
    return title_case(rest)


def segments(text: Column) -> Column:
    """Statements of a text: lines cut at punctuation and at and, but, also.

    Marks and line ends become points by a table of characters, so that one literal character is left to split at.
    """
    flat = F.translate(text, "!?;,\n", ".....")
    for word in ("and", "but", "also"):
        flat = F.regexp_replace(flat, f"(?i) (?:{word} )+", ". ")
    return F.filter(F.transform(F.split(flat, r"\."), squeeze), lambda s: s != "")


def clean_fact(text: Column) -> Column:
    """Without heading marks, one bullet and emphasis."""
    text = squeeze(F.regexp_replace(text, r"(?U)^(?:#+\s*)+", ""))
    text = squeeze(F.regexp_replace(text, r"^(?:- )?(?:\* )?(?:\+ )?", ""))
    return squeeze(F.regexp_replace(text, "[*_`]", ""))


def clean_intent(text: Column) -> Column:
    """Without heading marks, one bullet, a number, and emphasis at the edges."""
    text = squeeze(F.regexp_replace(text, r"(?U)^(?:#+\s*)+", ""))
    text = squeeze(F.regexp_replace(text, r"^[-*+] ", ""))
    text = squeeze(F.regexp_replace(text, r"^[0-9]+\. ", ""))
    return squeeze(F.regexp_replace(text, r"^[*_`]+|[*_`]+$", ""))


def fact(segment: Column) -> Column:
    """struct(subject, predicate, object) of the first pattern that fits, else null."""
    out = F.lit(None).cast("struct<subject:string,predicate:string,object:string>")
    for name, verb in reversed(PREDICATES):
        pattern = rf"(?id)^(.+?)\b{verb}\b(.+)"
        found = F.struct(
            title_case(clean_fact(F.regexp_extract(segment, pattern, 1))).alias("subject"),
            F.lit(name).alias("predicate"),
            title_case(clean_fact(F.regexp_extract(segment, pattern, 2))).alias("object"),
        )
        out = F.when(segment.rlike(pattern), found).otherwise(out)
    any_verb = "|".join(verb for _, verb in PREDICATES)
    # most statements fail the first quick test, and most others the second
    return F.when(holds(F.lower(segment), FACT_WORDS), F.when(segment.rlike(rf"(?i)\b(?:{any_verb})\b"), out))


def intent(segment: Column) -> Column:
    """The phrase from the earliest intent word on, title-cased; null without one."""
    phrase = F.regexp_extract(segment, rf"(?is)(?:{'|'.join(INTENT_WORDS)}).*$", 0)
    cleaned = once(clean_intent(F.regexp_replace(squeeze(phrase), r"[.,;!?]+$", "")), lambda p: F.when(p != "", title_case(p)))
    return F.when(holds(F.lower(segment), INTENT_WORDS), cleaned)  # most statements hold none


def author(raw: Column) -> Column:
    """struct(name, email) of ``Name <email>``, a bare address or a bare name."""
    full = r"^([^<]+)\s*<([^>]+)>$"
    bare = raw.contains("@") & ~raw.contains(" ")
    of = lambda name, email: F.struct(name.alias("name"), email.alias("email"))
    parts = of(squeeze(F.regexp_extract(raw, full, 1)), squeeze(F.regexp_extract(raw, full, 2)))
    return F.when(raw.rlike(full), parts).when(bare, of(F.lit(""), squeeze(raw))).otherwise(of(squeeze(raw), F.lit("")))


def clean_words(title: Column) -> Column:
    """The distinct words that can link two titles."""
    words = F.split(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), " ")
    return F.array_except(words, F.array(*[F.lit(w) for w in ("", *STOP_WORDS)]))


def topic_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def topic_score(tokens: Column, text: Column) -> Column:
    """10 for each token that the text contains."""
    low = F.lower(text)
    return F.aggregate(tokens, F.lit(0), lambda a, t: a + F.when(F.contains(low, t), 10).otherwise(0))


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4).cast("int")


def field_score(field: Column, term: str, weak: bool = False) -> Column:
    """How well a field fits a term; a trailing * asks for a prefix."""
    from ..constants import EXACT, PARTIAL, PREFIX, WEAK

    word, low = term.strip().rstrip("*").lower(), F.lower(squeeze(field))
    if not word:
        return F.lit(0)
    score = F.when(low == word, EXACT).when(low.startswith(word), PREFIX)
    if not term.strip().endswith("*"):
        score = score.when(low.contains(word), WEAK if weak else PARTIAL)
    return F.coalesce(score.otherwise(0), F.lit(0))


def file_paths(text: Column) -> Column:
    """Distinct paths with a file extension that a text names."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_\-]+(?:/[A-Za-z0-9_\-.]+)+\.[A-Za-z0-9]+"), F.lit(0)))


def parse_time(text: Column) -> Column:
    """Timestamps in the layouts that stores have written over time, UTC; null where none fits."""
    fixed = F.regexp_replace(text, r"([+-]\d{4}) [+-]\d{4}$", "$1")
    layouts = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS] Z", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(fixed, F.lit(x)) for x in layouts])
