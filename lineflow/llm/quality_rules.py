"""Quality rules, line first: bad lines go, then documents that lost too much.

Rules look at one line at a time: how it ends, whether it is navigation, whether it
is boilerplate.  A line that fails any of them is removed.  Lines of a hard-wrapped
paragraph are first judged together.  A document is rejected if the removed lines held
too large a share of its words' characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lineflow.llm.shipping import ship_package
from lineflow.llm.words import find_words, id_and_text

ROWS_AT_A_TIME = 256

SYMBOLS = "#*$%&|<>"

#: Fixed: what a finished line ends with, quotes and brackets left aside.
SENTENCE_ENDS = (".", "!", "?", ":", ";", "…", "。", "！", "？", "।", "؟", "۔")
CLOSING = "\"'”’»)]}›」』"

#: Fixed: signs between the entries of a menu.
SEPARATORS = "|>»›·•→/\\"

#: Fixed: phrases of notices, not of prose, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "javascript is disabled",
    "privacy policy",
    "terms of use",
    "terms of service",
    "terms and conditions",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "click here",
    "lorem ipsum",
    "copyright",
    "©",
    "released under the",
    "licensed under",
    "general public license",
    "skip to content",
    "page not found",
)


@dataclass(frozen=True)
class Rules:
    """Limits.  The first two are of documents, the rest of lines."""

    min_words: int = 50
    max_repeated_percent: int = 50
    #: Share of the word characters that removed lines may hold.
    max_lost: float = 0.5
    #: An unfinished line passes as prose if it has so many words, and a sentence end
    #: or comma for every so many of them.
    prose_words: int = 10
    prose_stops: float = 0.03
    #: Symbols by characters of a line.
    max_symbols: float = 0.1
    #: Separators by words of a line.
    max_separators: float = 0.2
    #: Words that end in two or more exclamation or question marks.
    max_shouting: float = 0.3
    #: Capitals by letters, in lines of at least so many letters.
    max_capitals: float = 0.6
    min_letters: int = 12
    #: Different words by words, in lines of at least so many words; on average over
    #: windows of at most so many.
    min_variety: float = 0.25
    variety_words: int = 12
    variety_window: int = 500
    #: A boilerplate phrase fails lines of fewer words, and lines of whose characters
    #: such phrases are so large a part.
    boilerplate_words: int = 25
    max_boilerplate: float = 0.1
    #: Paragraphs whose longest line has fewer characters are not hard-wrapped; in wider
    #: ones than max_wrap, each sentence is judged for itself.
    min_wrap: int = 30
    max_wrap: int = 200


_symbols = re.compile(f"[{re.escape(SYMBOLS)}]").findall
_separators = re.compile(f"[{re.escape(SEPARATORS)}]").findall
_stops = re.compile(r"[.!?,;:](?=[\x20\x09-\x0D])").findall
_shouts = re.compile(r"[!?]{2,}(?=[\x20\x09-\x0D]|$)").findall
_capitals = re.compile("[A-ZÀ-ÖØ-Þ]").findall
_letters = re.compile(r"[^\W\d_]").findall
_boilerplate = re.compile("|".join(map(re.escape, BOILERPLATE))).findall


def _variety(words: list[str], window: int) -> float:
    """Different words by words, on average over equal windows of at most ``window`` words."""
    n = len(words)
    if n <= window:
        return len(set(words)) / n
    cuts = -(-n // window)
    bounds = [n * k // cuts for k in range(cuts + 1)]
    return sum(len(set(words[a:b])) for a, b in zip(bounds, bounds[1:])) / n


def _ends_sentence(line: str) -> bool:
    return line.rstrip(" \t\r\v\f" + CLOSING).endswith(SENTENCE_ENDS)


def line_fault(line: str, words: list[str], rules: Rules, finished: bool = False) -> str | None:
    """The rule a line with words fails first, or None; ``finished``: it goes on in the next line."""
    n = len(words)
    if not finished and not _ends_sentence(line):
        if n < rules.prose_words or len(_stops(line)) < rules.prose_stops * n:
            return "punctuation"
    if len(_shouts(line)) > rules.max_shouting * n:
        return "punctuation"
    if len(_separators(line)) > rules.max_separators * n:
        return "navigation"
    if len(_symbols(line)) > rules.max_symbols * len(line):
        return "symbols"
    capitals = len(_capitals(line))
    if capitals >= rules.min_letters and capitals > rules.max_capitals * len(_letters(line)):
        return "capitals"
    if n >= rules.variety_words and _variety(words, rules.variety_window) < rules.min_variety:
        return "repetition"
    phrases = _boilerplate(line.lower())
    if phrases and (n < rules.boilerplate_words or sum(map(len, phrases)) > rules.max_boilerplate * len(line)):
        return "boilerplate"
    return None


def wrapped_paragraphs(lines: list[str], words: list[list[str]], rules: Rules) -> list[tuple[int, int]]:
    """First and last place of each run of lines that are one hard-wrapped text.

    A line was wrapped if the next line's first word would not have fitted behind it;
    the width is that of the longest line of several words between blank lines.  A run
    ends with its last finished sentence, and what follows is a run of its own.  Two
    lines, or wide ones, may be full by chance: these make runs of a sentence each.
    """
    found, start = [], 0
    while start < len(lines):
        end = start
        while end < len(lines) and words[end]:
            end += 1
        width = max((len(lines[k].rstrip()) for k in range(start, end) if len(words[k]) > 1), default=0)
        first = start
        for k in range(start, end):
            if k + 1 < end and len(lines[k].rstrip()) + 1 + len(words[k + 1][0]) > width:
                continue
            if first < k and width >= rules.min_wrap:
                stops = [place for place in range(first, k + 1) if _ends_sentence(lines[place])]
                if k - first > 1 and width <= rules.max_wrap:
                    stops = stops[-1:]
                bounds = [first, *(place + 1 for place in stops), k + 1]
                found += [(a, b - 1) for a, b in zip(bounds, bounds[1:]) if b - a > 1]
            first = k + 1
        start = end + 1
    return found


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more, the first included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    inside, covered = 0, 0  # the place up to which words are counted
    for place, window in enumerate(windows):
        if times[window] > 1:
            inside += place + 3 - max(covered, place)
            covered = place + 3
    return inside


def assess(text: str, rules: Rules) -> tuple[dict[str, int], str]:
    """Counts of a text, and the text without the lines that fail."""
    words = find_words(text)
    kept, faults, seen, repeats, lost = [], Counter(), set(), 0, 0
    lines = text.split("\n")
    by_line = [find_words(line) for line in lines]
    #: By place, what the wrapped paragraph of a line says of it: sound, or only finished.
    sound, finished = set(), set()
    for first, last in wrapped_paragraphs(lines, by_line, rules):
        places = range(first, last + 1)
        fault = line_fault(" ".join(lines[k].strip() for k in places), [w for k in places for w in by_line[k]], rules)
        if fault is None:
            sound.update(places)
        elif fault != "punctuation":
            finished.update(places)
    for place, (line, own) in enumerate(zip(lines, by_line)):
        if not own:
            kept.append(line)
            continue
        if line in seen:
            repeats += 1
            fault = "duplicate"
        else:
            seen.add(line)
            fault = None if place in sound else line_fault(line, own, rules, place in finished)
        if fault is None:
            kept.append(line)
        else:
            faults[fault] += 1
            lost += sum(map(len, own))
    counts = {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(_symbols(text)),
        "n_dup_lines": repeats,
        "n_repeat_words": repeated_words(words),
        "lost_chars": lost,
        "n_lines": len(seen) + repeats,
        "n_bad_lines": faults.total(),
        "n_boilerplate": faults["boilerplate"],
        "n_navigation": faults["navigation"],
        "n_punctuation": faults["punctuation"],
    }
    return counts, "\n".join(kept)


COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "lost_chars",
    "n_lines",
    "n_bad_lines",
    "n_boilerplate",
    "n_navigation",
    "n_punctuation",
)


def verdict(counts: dict[str, int], rules: Rules) -> tuple[bool, bool]:
    """If a text with these counts fails the base rules, and if it is kept."""
    few = counts["n_words"] < rules.min_words
    failed = few or 100 * counts["n_repeat_words"] > rules.max_repeated_percent * counts["n_words"]
    return failed, not failed and counts["lost_chars"] <= rules.max_lost * counts["word_chars"]


def clean_documents(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row doc_id, its counts, ``base_failed``, ``kept`` and ``cleaned``, the text that is left.

    A document fails the base rules if it has too few words or repeats too many.
    It is kept if it passes them and loses no more than its share to the line rules.
    Null and empty texts have no words and fail.  Null and repeated ids pass through;
    rows are judged one by one, in place, without a shuffle.
    """
    ship_package(docs.sparkSession)
    rows = id_and_text(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{name} long" for name in COUNTS)
    schema = f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, cleaned string"
    return rows.mapInArrow(_assess_batches(rules), schema)


def _assess_batches(rules: Rules) -> Callable[[Iterator], Iterator]:
    def assess_batches(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                found = [assess(text, rules) for text in part.column(1).to_pylist()]
                columns = [pa.array([counts[name] for counts, _ in found], pa.int64()) for name in COUNTS]
                verdicts = [verdict(counts, rules) for counts, _ in found]
                columns += [pa.array([v[k] for v in verdicts], pa.bool_()) for k in (0, 1)]
                columns.append(pa.array([text for _, text in found], pa.string()))
                names = ["doc_id", *COUNTS, "base_failed", "kept", "cleaned"]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return assess_batches


def keep_good_documents(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the cleaned text and all columns.

    The verdict is computed next to the row it belongs to, so nothing is joined, and
    rows that repeat an id are judged each by its own text.
    """
    ship_package(docs.sparkSession)

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                part = batch.slice(start, ROWS_AT_A_TIME)
                at = part.schema.get_field_index(text)
                found = [assess(content or "", rules) for content in part.column(at).to_pylist()]
                good = [verdict(counts, rules)[1] for counts, _ in found]
                columns = list(part.columns)
                columns[at] = pa.array([left for _, left in found], pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
