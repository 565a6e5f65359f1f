"""Quality rules by line-first cleaning, in Spark SQL expressions only.

Every line is judged on its own by punctuation, navigation and boilerplate rules; failing lines
go, and a document that loses more than ``MAX_LOST`` of its characters is rejected. No row leaves
its partition: there is no shuffle. A text in which no rule can find anything is not judged by lines:
one pattern over the whole text says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let, packed, unpacked

#: A document may lose at most this share of its word characters.
MAX_LOST = 0.3
MIN_WORDS = 50
#: Phrases of page furniture, looked for in lines of at most BOILERPLATE_WORDS words.
BOILERPLATE = (
    "all rights reserved",
    "alle rechte vorbehalten",
    "tous droits réservés",
    "todos los derechos reservados",
    "privacy policy",
    "datenschutzerklärung",
    "politique de confidentialité",
    "política de privacidad",
    "terms of use",
    "terms of service",
    "nutzungsbedingungen",
    "conditions d’utilisation",
    "términos de uso",
    "use cookies",
    "cookie policy",
    "verwendet cookies",
    "utilise des cookies",
    "utiliza cookies",
    "enable javascript",
    "lorem ipsum",
    "newsletter",
    "click here to",
    "share this article",
    "skip to content",
)
BOILERPLATE_WORDS = 12
#: Lines of at most so many words need a sentence's end.
FRAGMENT_WORDS = 3
SYMBOLS = "#*$%&|<>"
#: Different windows that repeat: so many are looked up in a list, more are found by sorting.
FEW = 32
#: Regular expressions, in what Java's and RE2's have in common. SPACE is all white space of the contract.
SPACE = r"[\x20\x09-\x0D]"
SEPARATOR = r"[|›»•·]"
LINK = r"://|www\."
NUMBER = r"^[0-9][0-9.,:/%-]*$"
SMALL, CAPITAL = r"\p{Ll}", r"\p{Lu}"
OTHER = r"[^\pL\pM\pN]"
#: What a sentence may end with; a letter, a digit or another mark is no end.
ENDING = r"[.!?…:;。！？\x22'”’»)\]]\z"
#: A text that none of these meets has no failing line: a symbol, a separator, an exclamation mark or a digit;
#: two other characters with at most one letter between them; a line without small letters; one without an
#: ending. Apart they are far quicker than in one expression.
SUSPECT = (
    r"[#*$%&|<>›»•·!0-9]",
    r"[^\pL\pM\pN\x20\x09-\x0D][\x20\x09-\x0D]*[\pL\pM\pN]?[\x20\x09-\x0D]*[^\pL\pM\pN\x20\x09-\x0D]",
    r"(?:\A|\n)[^\p{Ll}\n]++(?:\n|\z)",
    r"\n(?<![.!?…:;。！？\x22'”’»)\]\n]\n)|\z(?<![.!?…:;。！？\x22'”’»)\]\n])",
)
SUSPECT_TEXTS = ("://", "www.")


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _count_sql(text: str, pattern: str) -> str:
    """Characters of text that the class ``pattern`` holds."""
    return f"(length({text}) - length(regexp_replace({text}, {_lit(pattern)}, '')))"


def _trim_sql(text: str) -> str:
    return f"btrim({text}, ' \\u0009\\u000a\\u000b\\u000c\\u000d')"


def _words_sql(text: str) -> str:
    """SQL array of the words of ``text``."""
    return let("x_", _trim_sql(text), f"if(x_ = '', cast(array() as array<string>), split(x_, {_lit(SPACE + '+')}))")


def line_fails_sql(line: str) -> str:
    """SQL boolean: the line fails a rule. Lines without a word never fail. No rule but the phrases depends
    on a language.

    navigation: segments of at most three words on average, between separators;
    punctuation: a symbol or an exclamation mark for every second word, or less than half of the
    characters are letters, digits or marks, or more than half of the words are numbers, in a line of three
    words or more;
    fragment: up to three words without a sentence's end;
    shouting: three words or more, without a small letter;
    links: a link for every second word;
    boilerplate: a short line with a phrase of ``BOILERPLATE``.
    """
    phrases = " or ".join(f"contains(lower({line}), {_lit(p)})" for p in BOILERPLATE)
    bare = f"length(regexp_replace({line}, {_lit(SPACE)}, ''))"
    rules = (
        f"(n_ <= {FRAGMENT_WORDS} and not {_trim_sql(line)} rlike {_lit(ENDING)})",
        f"(2 * {_count_sql(line, f'[{SYMBOLS}]')} >= n_)",
        f"(n_ - {_count_sql(line, SEPARATOR)} <= 3 * ({_count_sql(line, SEPARATOR)} + 1) and {line} rlike {_lit(SEPARATOR)})",
        f"(n_ >= 3 and 2 * {_count_sql(line, '!')} >= n_)",
        f"(n_ >= 3 and not {line} rlike {_lit(SMALL)} and {line} rlike {_lit(CAPITAL)})",
        f"(n_ >= 3 and 2 * length(regexp_replace({line}, {_lit(OTHER)}, '')) < {bare})",
        f"(n_ >= 3 and 2 * size(filter(v_, w_ -> w_ rlike {_lit(NUMBER)})) > n_)",
        f"(2 * size(regexp_extract_all({line}, {_lit(LINK)}, 0)) >= n_)",
        f"(f_ and n_ <= {BOILERPLATE_WORDS} and ({phrases}))",
    )
    return let("v_", _words_sql(line), let("n_", "size(v_)", f"n_ > 0 and ({' or '.join(rules)})"))


def _repeat_words_sql(words: str) -> str:
    """Words in 3-word windows that occur twice or more, the first included: sort the window hashes, keep
    the places of those with equal neighbours, and count what their windows cover."""
    hashes = f"slice(transform({words}, (x_, i_) -> xxhash64(x_, get({words}, i_ + 1), get({words}, i_ + 2))), 1, greatest(0, size({words}) - 2))"
    twice = "filter(s_, (x_, i_) -> x_.h = get(s_, i_ - 1).h or x_.h = get(s_, i_ + 1).h)"
    places = f"sort_array(transform({twice}, x_ -> x_.i))"
    covered = "aggregate(transform(r_, (p_, i_) -> least(3, coalesce(get(r_, i_ + 1) - p_, 3))), 0L, (a_, b_) -> a_ + b_)"
    many = let("s_", "sort_array(transform(h_, (h, i) -> named_struct('h', h, 'i', i)))", let("r_", places, covered))
    few = let("r_", "filter(transform(h_, (x_, i_) -> if(array_contains(d_, x_), i_, -1)), i_ -> i_ >= 0)", covered)
    slow = let("o_", "sort_array(h_)", let("d_", "array_distinct(filter(o_, (x_, i_) -> x_ = get(o_, i_ + 1)))", f"if(size(d_) <= {FEW}, {few}, {many})"))
    return let("h_", hashes, f"case when size(array_distinct(h_)) = size(h_) then 0L else {slow} end")


def _verdict_sql() -> str:
    """SQL struct of all counts, the verdict and the clean text; evaluated once a row."""
    text = "coalesce(text, '')"
    lines = "split(t_, '\\n')"
    phrases = let("y_", "lower(t_)", " or ".join(f"contains(y_, {_lit(p)})" for p in BOILERPLATE))
    stay = f"array_join(filter({lines}, x_ -> not {line_fails_sql('x_')}), '\\n')"
    suspect = " or ".join([*(f"contains(t_, '{x}')" for x in SUSPECT_TEXTS), *(f"t_ rlike {_lit(x)}" for x in SUSPECT)])
    clean = let("f_", phrases, f"if(f_ or {suspect}, {stay}, t_)")
    repeated = let("l_", lines, f"case when size(array_distinct(l_)) = size(l_) then 0 else {let('d_', f'filter(l_, x_ -> x_ rlike {_lit("[^" + SPACE[1:])})', 'size(d_) - size(array_distinct(d_))')} end")
    counts = let(
        "w_all",
        _words_sql("t_"),
        "named_struct("
        "'n_words', cast(size(w_all) as bigint), "
        "'word_chars', cast(length(array_join(w_all, '')) as bigint), "
        f"'n_symbols', cast({_count_sql('t_', f'[{SYMBOLS}]')} as bigint), "
        f"'n_dup_lines', cast({repeated} as bigint), "
        f"'n_repeat_words', {_repeat_words_sql('w_all')}, "
        f"'clean_text', {clean})",
    )
    fields = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    failed = f"k_.n_words < {MIN_WORDS} or 100 * k_.n_repeat_words > 50 * k_.n_words"
    lost = f"(k_.word_chars - length(regexp_replace(k_.clean_text, {_lit(SPACE + '+')}, '')))"
    kept = f"not ({failed}) and (k_.clean_text = t_ or 10 * {lost} <= {round(10 * MAX_LOST)} * k_.word_chars)"
    verdict = f"named_struct({', '.join(f'{chr(39)}{f}{chr(39)}, k_.{f}' for f in fields)}, 'base_failed', {failed}, 'kept', {kept}, 'clean_text', k_.clean_text)"
    return let("t_", text, let("k_", counts, verdict))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Add ``q``: a struct with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept and clean_text (the lines that stay, joined by newline) to every row; other columns stay.

    Null and empty texts have no words and fail the base rules; repeated rows are judged alike and
    each stays; an empty table gives an empty table; the only column that is read is ``text``, and a
    column named ``q`` is replaced. Whole texts of any length are judged.
    """
    return docs.withColumn("q", F.expr(_verdict_sql()))


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the text that stays and its n_chars, in the columns they came with.

    The verdict is exploded from an array that is empty for a rejected document: a filter on it would be
    pushed below the projection and judge every document twice.
    """
    own = packed(docs, text=F.col("text"))
    kept = own.select("row", F.explode(F.filter(F.array(F.expr(_verdict_sql())), lambda q: q["kept"])).alias("q"))
    new = {"text": F.col("q.clean_text"), "n_chars": F.length("q.clean_text").cast("bigint")}
    return unpacked(kept, docs.columns, **{c: new[c] for c in new if c in docs.columns})
