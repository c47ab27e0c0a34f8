"""Text functions as Column expressions: answers, cleaning, n-grams, chat messages, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.vectors import bound

# Decimal digits outside ASCII that answers use, for translate(): full-width, Arabic-Indic, extended Arabic-Indic, Devanagari.
_ZEROS = (0xFF10, 0x0660, 0x06F0, 0x0966)
_OTHER_DIGITS = "".join(chr(z + d) for z in _ZEROS for d in range(10))
_ASCII_DIGITS = "0123456789" * len(_ZEROS)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed patterns: a mark that groups thousands, a decimal comma, a number.
GROUPING, DECIMAL_COMMA, NUMBER = r"(?<=\d)[,.](?=\d{3}(?!\d))", r"(?<=\d),(?=\d)", r"-?\d+(?:\.\d+)?"


def last_number(text: Column | str) -> Column:
    """The last number in a text as a double, null if there is none.

    A comma or point before exactly three digits groups thousands; any other comma between digits is a decimal one.
    """
    t = F.translate(_col(text), _OTHER_DIGITS, _ASCII_DIGITS)
    t = F.regexp_replace(F.regexp_replace(t, GROUPING, ""), DECIMAL_COMMA, ".")
    return F.try_element_at(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), F.lit(-1)).try_cast("double")


def last_letter(text: Column | str, letters: str = "A-D") -> Column:
    """The last capital of ``letters`` that no other ASCII letter touches, else null."""
    found = F.regexp_extract_all(_col(text), F.lit(f"(?<![A-Za-z])([{letters}])(?![A-Za-z])"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


# Fixed patterns: the marker before an answer letter, and the letter with the marks that may wrap it.
MARKER = r"(?:(?i:answer|respuesta)|答案)\s*(?:\*\*|__)?\s*[:：]"
LETTER = r"[\s*_`$(\[{]*(?:\\(?:boxed|text|textbf)\{)?[\s*_`$(\[{]*([A-J])(?![A-Za-z])"


def parse_letter(text: Column | str) -> Column:
    """The letter right behind the last answer marker; null if there is no marker or no letter there. The tail is cut first, so an earlier marker never answers."""
    t = _col(text)
    tail = F.regexp_extract(t, f"(?sU)^.*(?:{MARKER})(.*)$", 1)
    letter = F.regexp_extract(tail, f"(?U)^{LETTER}", 1)
    return F.when(t.rlike(f"(?U){MARKER}") & (letter != ""), letter)


def chars(text: Column | str) -> Column:
    """Code points; a null text has none."""
    return F.coalesce(F.length(_col(text)), F.lit(0)).cast("long")


def strip(text: Column | str) -> Column:
    """Text without white space (in the Unicode sense) at its ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def is_blank(text: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(text), F.lit("")) == ""


def normalised(text: Column | str) -> Column:
    """Lower case, one space between runs of word characters. Compatibility forms need ``udfs.nfkc`` first."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"(?U)[^\w]+", " "))


def ngrams(words: Column | str, n: int) -> Column:
    """Distinct n-grams of an array of words; none if it is shorter. Give the array as a column of its own: an expression here would be computed for every gram."""
    w = _col(words)
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def of_role(messages: Column | str, role: str) -> Column:
    return F.filter(_col(messages), lambda m: m["role"] == role)


def user_turns(messages: Column | str) -> Column:
    """Contents of all user turns, a line each."""
    return F.array_join(F.transform(of_role(messages, "user"), lambda m: m["content"]), "\n")


def count_in_messages(messages: Column | str, mark: str) -> Column:
    """Occurrences of ``mark`` in all contents."""
    one = lambda m: (F.length(m["content"]) - F.length(F.replace(m["content"], F.lit(mark), F.lit("")))) / len(mark)
    return F.aggregate(F.transform(_col(messages), lambda m: F.coalesce(one(m), F.lit(0.0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def one_split(messages: Column | str, mark: str = "</think>") -> Column:
    """Whether ``mark`` occurs once in all messages, and in the last one, which is the assistant's."""
    last = F.try_element_at(_col(messages), F.lit(-1))
    return F.coalesce((count_in_messages(messages, mark) == 1) & (last["role"] == "assistant") & last["content"].contains(mark), F.lit(False))


def before_mark(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def after_mark(text: Column, mark: str) -> Column:
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def mixed_arm(own: Column | str, other: Column | str, mark: str = "</think>") -> Column:
    """``own`` messages whose last one reasons as the last of ``other`` does and answers as its own does."""
    own, other = _col(own), _col(other)
    a, b = F.element_at(own, -1)["content"], F.element_at(other, -1)["content"]
    text = F.concat(before_mark(b, mark), F.lit(mark), after_mark(a, mark))
    return F.concat(F.slice(own, 1, F.size(own) - 1), F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content"))))


def letter_of(number: Column) -> Column:
    """1 -> A, 2 -> B, ..."""
    return F.char(number.cast("long") + 64)


def compacted(options: Column | str) -> Column:
    """Options that aren't null or blank, in order."""
    return F.filter(_col(options), lambda o: o.isNotNull() & (F.trim(o) != ""))


def compacted_gold(options: Column | str, index: Column) -> Column:
    """Letter of option ``index`` (from 0) after compaction; null if that option is empty."""
    options = _col(options)
    chosen = F.try_element_at(options, (index + 1).cast("int"))
    before = F.size(compacted(F.slice(options, F.lit(1), (index + 1).cast("int"))))
    return F.when(chosen.isNotNull() & (F.trim(chosen) != ""), letter_of(before))


def compacted_gold_strict(options: Column | str, index: Column) -> Column:
    """As ``compacted_gold``; an empty or missing option stops the query."""
    letter = compacted_gold(options, index)
    return F.when(letter.isNotNull(), letter).otherwise(F.raise_error(F.lit("the answer is an empty option")).cast("string"))


def choice_prompt(question: Column, options: Column, template: Column | str) -> Column:
    """``template`` with {question} and {options}, options lettered and a line each."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(letter_of(i + 1), F.lit(". "), o)), "\n")
    template = F.lit(template) if isinstance(template, str) else template
    return F.replace(F.replace(template, F.lit("{question}"), question), F.lit("{options}"), lines)


def localised(lang: Column | str, table: dict[str, str], default: str | None = None) -> Column:
    """The text that ``table`` has for a language; ``default`` (or null) for others."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), _col(lang)), F.lit(default))


def composite_key(*parts: Column | str) -> Column:
    """Parts joined by colons; null if one is missing."""
    text = [_col(p).cast("string") for p in parts]
    whole = text[0].isNotNull()
    for t in text[1:]:
        whole = whole & t.isNotNull()
    return F.when(whole, F.concat_ws(":", *text))


def present_json(*columns: str) -> Column:
    """The columns as one JSON object in their order; a null one is left out. Characters outside ASCII stay as they are."""
    return F.to_json(F.struct(*columns))


def domain(dataset: Column | str, source: Column | str) -> Column:
    """``math`` where either name says so, else the dataset's name."""
    said = F.lower(F.concat_ws(" ", _col(dataset), _col(source)))
    return F.when(said.contains("math"), "math").otherwise(_col(dataset))


# Frequent words by language, for the heuristic detector.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was"),
    "es": ("el", "la", "de", "que", "los", "del", "las", "por", "con", "una"),
    "fr": ("le", "les", "des", "du", "et", "est", "un", "dans", "pour", "par"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "von", "mit", "den", "ein"),
}


def detect_language(text: Column | str, languages: tuple[str, ...] = ("en", "es", "fr", "de", "zh")) -> Column:
    """Heuristic language: Han characters, else most stop words (ties: order of ``STOP_WORDS``); ``other`` without any, ``none`` for blank text. Not a statistical detector; ``udfs.detected`` takes one. The text is split once."""
    t = F.coalesce(_col(text), F.lit(""))
    own = [k for k in STOP_WORDS if k in languages]

    def best(words: Column) -> Column:
        hits = [F.struct(_hits(words, STOP_WORDS[k]).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, k in enumerate(own)]
        return bound(F.greatest(*hits), lambda b: F.when(b["n"] == 0, "other").otherwise(b["lang"]))

    every = sorted({w for k in own for w in STOP_WORDS[k]})
    found = F.filter(F.split(F.lower(t), r"[\x20\n]"), lambda w: w.isin(*every))
    han = F.regexp_count(t, F.lit("[一-鿿]")) * 5 > F.length(t) if "zh" in languages else F.lit(False)
    return F.when(F.trim(t) == "", "none").when(han, "zh").otherwise(bound(found, best))


def _hits(words: Column, stop: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*stop)))


def rendered_chat(messages: Column | str, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Messages as one text: role and content between turn marks."""
    one = lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(f"{end}\n"))
    return F.array_join(F.transform(_col(messages), one), "")


def loss_labels(ids: Column | str, offsets: Column | str, start: Column, end: Column, ignore: int = -100) -> Column:
    """Token ids as labels where a token's offsets (start, end) lie within a span of the text, ``ignore`` elsewhere."""
    inside = lambda t, o: F.when((o["start"] >= start) & (o["end"] <= end), t).otherwise(F.lit(ignore).cast("long"))
    return F.zip_with(_col(ids), _col(offsets), inside)
