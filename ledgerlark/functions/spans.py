"""Where texts in Japanese and Korean name reductions: one automaton for all words, and places in the text as it came.

Words are looked for in a shadow of the text: compatibility forms folded, white space left out, so that line breaks inside a word don't
hide it. Every letter of the shadow knows the letters of the text that it stands for.
"""

from __future__ import annotations

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by language and how sure they are.
STRONG_JA = ("整理解雇", "希望退職", "早期退職", "退職勧奨", "人員削減", "人員整理")
CONTEXT_JA = ("リストラ", "構造改革", "事業構造改善", "雇用調整", "工場閉鎖", "事業所閉鎖", "操業停止", "特別退職金", "割増退職金", "人員適正化")
STRONG_KO = ("정리해고", "희망퇴직", "명예퇴직", "권고사직", "인력감축", "인원감축", "경영상해고")
CONTEXT_KO = ("구조조정", "사업철수", "공장폐쇄", "퇴직위로금", "특별퇴직금", "고용조정", "감원")
#: Words of fewer letters must stand unbroken, and not inside a longer Hangul word.
LEAST_BROKEN = 3
VOCABULARY = {word: (language, tier) for language, tier, words in (("ja", "strong", STRONG_JA), ("ja", "context", CONTEXT_JA), ("ko", "strong", STRONG_KO), ("ko", "context", CONTEXT_KO)) for word in words}
#: Blocks of Hangul, kana and Chinese characters, wide and half-width.
EASTERN = "\u1100-\u11ff\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3040-\u30ff\u3130-\u318f\u31f0-\u31ff\u3200-\u33ff\u3400-\u4dbf\u4e00-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff\uff66-\uffdc\U00020000-\U0003ffff"
SPANS = "array<struct<start: int, end: int, language: string, tier: string, word: string>>"


def _finder():
    """The search of one text; made once a task."""
    import unicodedata

    import ahocorasick
    import regex

    words = ahocorasick.Automaton()
    for word in VOCABULARY:
        words.add_word(word, word)
    words.make_automaton()
    # A word lies inside one run of Eastern letters, white space and marks; only these runs are folded.
    runs = re.compile(rf"[{EASTERN}][{EASTERN}\s\u0300-\u036f\uff9e\uff9f]*")
    cluster, hangul = regex.compile(r"\X"), re.compile(r"[가-힣]")

    def shadow(text: str) -> tuple[str, list[int], list[int]]:
        """The folded text without white space, and for each of its letters where what it stands for begins and ends in the text."""
        letters, begins, ends = [], [], []
        for found in cluster.finditer(text):
            for letter in unicodedata.normalize("NFKC", found[0]):
                if not letter.isspace():
                    letters.append(letter)
                    begins.append(found.start())
                    ends.append(found.end())
        return "".join(letters), begins, ends

    def search(text: str) -> list[dict]:
        folded, begins, ends = shadow(text)
        out = []
        for last, word in words.iter(folded):
            first = last - len(word) + 1
            start, end = begins[first], ends[last]
            if len(word) < LEAST_BROKEN:
                joined = all(ends[i] == begins[i + 1] for i in range(first, last))
                before = first > 0 and ends[first - 1] == start and hangul.match(folded[first - 1])
                behind = last + 1 < len(folded) and begins[last + 1] == end and hangul.match(folded[last + 1])
                if not joined or before or behind:
                    continue
            out.append({"start": start, "end": end, "language": VOCABULARY[word][0], "tier": VOCABULARY[word][1], "word": word})
        return out

    def find(text: str) -> list[dict]:
        if text.isascii():
            return []
        found = [s | {"start": s["start"] + run.start(), "end": s["end"] + run.start()} for run in runs.finditer(text) for s in search(run[0])]
        return sorted(found, key=lambda s: (s["start"], s["word"]))

    return find


def reduction_spans(text: Column) -> Column:
    """All places of the vocabulary in a text, in order: code points from ``start`` to ``end`` of the text as it is, language, tier and word."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder()
        for texts in batches:
            yield pd.Series([find(t) if t else [] for t in texts])

    return F.pandas_udf(run, SPANS)(text)
