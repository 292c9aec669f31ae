"""Text expressions: strip, line split, unit clean-up and the four unit splitters.

Everything here is a built-in Spark expression; null text gives null (splitters: null array).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: white space as Python's str.strip sees it; line ends as str.splitlines sees them ---
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# --- fixed values: unit markers, sentence shape and clause openers of the data format ---
UNIT_MARKER = rf"(?U)^[{SPACE}]*(?:[-*][{SPACE}]+|\d+[).{SPACE}-]+)"
SENTENCE = r"[^.!?]+[.!?]|[^.!?]+\z"
CLAUSE_OPENERS = ["but", "so", "yet", "nor", "because", "since", "although", "when", "if", "unless", "until"]
CLAUSE_OPENERS_AFTER_COMMA = [
    "and", "or", "while", "as", "therefore", "however", "moreover", "furthermore", "consequently", "thus", "hence", "then",
    "additionally", "also", "alternatively", "similarly", "conversely", "meanwhile", "instead",
]
CLAUSE_BREAK = (
    rf"(?iU)(?:,[{SPACE}]*|[{SPACE}]+)(?=(?:{'|'.join(CLAUSE_OPENERS)})\b)"
    rf"|,[{SPACE}]*(?=(?:{'|'.join(CLAUSE_OPENERS_AFTER_COMMA)})\b)"
)


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone only knows U+0020). Trimming by a set looks at the ends only; a pattern
    would be tried at every character."""
    return F.trim(text, F.lit(WHITE))


def lines(text: Column) -> Column:
    return F.split(text, LINE_END, -1)


def clean_unit(text: Column) -> Column:
    """Drop one leading bullet or list number, then strip. Leading operands go too (``5 x 4`` gives ``x 4``)."""
    return strip(F.regexp_replace(text, UNIT_MARKER, ""))


def _kept(parts: Column, clean: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(parts, clean), lambda unit: unit != "")


def split_lines(text: Column) -> Column:
    return _kept(lines(text), clean_unit)


def split_sentences(text: Column) -> Column:
    return _kept(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), strip)


def split_clauses(text: Column) -> Column:
    return F.flatten(F.transform(split_lines(text), lambda line: _kept(F.split(line, CLAUSE_BREAK, -1), strip)))


def split_numbered_or_lines(text: Column) -> Column:
    """Lines when there are at least two of them, else the sentences of the raw text."""
    by_line = split_lines(text)
    return F.when(F.size(by_line) > 1, by_line).otherwise(split_sentences(text))


SPLITTERS = {
    "numbered_or_lines": split_numbered_or_lines,
    "lines": split_lines,
    "sentences": split_sentences,
    "clauses": split_clauses,
}


def split_units(text: Column, strategy: str = "numbered_or_lines") -> Column:
    if strategy not in SPLITTERS:
        raise ValueError(f"unknown unit split strategy: {strategy}")
    return SPLITTERS[strategy](text)


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def stop_at_newlines(text: Column, most: int) -> Column:
    """What a generator halted at its ``most``-th newline would have written."""
    return F.substring_index(text, "\n", most)


def ascii_json_string(text: Column) -> Column:
    """A JSON string literal with every non-ASCII UTF-16 unit escaped, byte for byte as Python's ``json.dumps`` writes it."""
    named = {"0022": '\\"', "005C": "\\\\", "000A": "\\n", "000D": "\\r", "0009": "\\t", "0008": "\\b", "000C": "\\f"}

    def unit(code: Column) -> Column:
        out = F.when(code.between("0020", "007E"), F.chr(F.conv(code, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(code)))
        for key, value in named.items():
            out = F.when(code == key, F.lit(value)).otherwise(out)
        return out

    codes = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    escaped = F.concat(F.lit('"'), F.array_join(F.transform(codes, unit), ""), F.lit('"'))
    return F.when(text.rlike(r'^[ !#-\[\]-~]*\z'), plain).otherwise(escaped)


def stable_row_id(round_id: Column, question: Column, depth: Column, start: Column, end: Column) -> Column:
    """``pt-`` and 16 hex digits of SHA-256 over the row key's JSON with sorted keys."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    quoted = lambda c: F.coalesce(ascii_json_string(c), F.lit("null"))
    payload = F.concat(
        F.lit('{"depth": '), number(depth), F.lit(', "question": '), quoted(question), F.lit(', "removed_end_index": '), number(end),
        F.lit(', "removed_start_index": '), number(start), F.lit(', "round_id": '), quoted(round_id), F.lit("}"),
    )
    return F.concat(F.lit("pt-"), F.substring(F.sha2(payload, 256), 1, 16))
