"""Line-first cleaning: rules look at each line, failing lines go, and a
document goes when it has lost too much of its text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_batches

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_SEPARATOR = re.compile(r"\s(?:\||»|›|•|·|>|/|::)\s")
_SHOUT = re.compile(r"[!?]{2,}(?=\s|$)")
_MENU = re.compile(r"^\W*(?:home|menu|login|log in|sign (?:in|up)|register|next|previous|back to top|share|"
                   r"read more|click here|search|sitemap|contact(?: us)?|about(?: us)?|skip to content)\W*$", re.I)
_BOILERPLATE = re.compile(r"all rights reserved|cookie policy|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|"
                          r"enable javascript|lorem ipsum|powered by|subscribe to our newsletter|copyright (?:©|\(c\))", re.I)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document verdict."""

    #: navigation: separators a line may have for each of its words
    separators_per_word: float = 0.2
    #: punctuation: share of a line's words that end in repeated ! or ?
    shouting: float = 0.3
    #: punctuation: symbols of ``SYMBOLS`` for each word
    symbols_per_word: float = 0.5
    #: punctuation: lines of fewer words must end in a mark
    unfinished_words: int = 4
    #: boilerplate: a notice is at most so many words long
    notice_words: int = 30
    #: boilerplate: share of different words, for lines of 20 words and more
    distinct_words: float = 0.15
    #: a document is rejected when it loses more than this share of its word characters
    max_lost: float = 0.5


def line_failure(line: str, rules: LineRules = LineRules()) -> str | None:
    """The family of the first rule that the line fails, or None. Lines
    without a word fail nothing."""
    words = line.split()
    if not words:
        return None
    n = len(words)
    if len(_SEPARATOR.findall(line)) > rules.separators_per_word * n or n <= 4 and _MENU.match(line):
        return "navigation"
    if (n <= rules.notice_words and _BOILERPLATE.search(line)
            or n >= 20 and len(set(words)) < rules.distinct_words * n):
        return "boilerplate"
    if (sum(map(line.count, SYMBOLS)) > rules.symbols_per_word * n
            or ("!!" in line or "??" in line) and len(_SHOUT.findall(line)) > rules.shouting * n
            or n < rules.unfinished_words and line.rstrip()[-1].isalnum()):
        return "punctuation"
    return None


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    repeated = 0
    if len(found) < len(windows):
        end = 0  # words before it are counted already
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated)


def clean_text(text: str | None, rules: LineRules = LineRules()) -> tuple[str, float, Counter]:
    """The text without its failing lines, the share of word characters lost,
    and the number of failing lines by family."""
    kept, failed, total, lost = [], Counter(), 0, 0
    for line in (text or "").split("\n"):
        chars = len(line) - sum(map(line.count, _SPACE))
        total += chars
        if why := line_failure(line, rules):
            failed[why] += 1
            lost += chars
        else:
            kept.append(line)
    return "\n".join(kept), lost / total if total else 0.0, failed


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_navigation", "n_boilerplate", "n_punctuation")),
    ("lost_share", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string())])
_DDL = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "n_navigation bigint, n_boilerplate bigint, n_punctuation bigint, lost_share double, base_failed boolean, "
        "kept boolean, clean_text string")


def judge(doc_id: int | None, text: str | None, rules: LineRules = LineRules()) -> tuple:
    """One row of :func:`line_first_cleaning`."""
    m = measures(text)
    base_failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
    clean, lost, failed = clean_text(text, rules)
    return (doc_id, *m, failed["navigation"], failed["boilerplate"], failed["punctuation"], lost, base_failed,
            not base_failed and lost <= rules.max_lost, clean)


def line_first_cleaning(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its measures, failing lines by
    family, share of text lost, verdict and cleaned text.

    A null text counts as empty; a text without words fails the base rules
    and is not kept; a null id stays null; repeated rows give repeated rows;
    an empty table gives none. Other columns of ``docs`` are ignored. One pass
    over the rows, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (judge(i.as_py(), t.as_py(), rules) for b in batches for i, t in zip(b.column(0), b.column(1)))
        return in_batches(rows, _SCHEMA, lambda r: len(r[-1]))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _DDL)


def keep_clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected documents, the others with their cleaned
    text; all columns and their order stay."""

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            keep, clean = [], []
            for t in b.column(at):
                row = judge(None, t.as_py(), rules)
                keep.append(row[-2])
                if row[-2]:
                    clean.append(row[-1])
            left = b.filter(pa.array(keep, pa.bool_()))
            yield left.set_column(at, left.schema.field(at), pa.array(clean, left.schema.field(at).type))

    return docs.mapInArrow(verdict, docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Line-first cleaning of all documents, without the cleaned texts."""
    from .common import documents

    out = line_first_cleaning(documents(spark, sf_dir))
    return out.withColumn("clean_crc32", F.crc32("clean_text")).drop("clean_text")
