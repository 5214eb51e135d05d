"""License scans by conditional compression.

Candidate blocks are sentences of a document's lines that name a license or copyright.
Each distinct block is compressed alone and with each template as a raw Zstandard
dictionary. The relative reduction in size ranks the templates; all that reach
LEAST_REDUCTION are compared word by word, and the best one whose exact wording differs from the block
only in free places is confirmed. Differences in numbers, versions or names of licenses
are never free: such a block is reported unconfirmed under its nearest template.

Wrapped and longer notices are found too: in each paragraph (lines up to a blank one,
whitespace folded) windows of GRAM words locate the span of each template, which is
compared in the same way. A confirmed span replaces the unconfirmed sentences it meets.

Defined cases: null and empty texts have no block; ties go to the smaller difference,
then the template's name; repeated rows are each reported; a block of any length is
compressed whole; extra columns stay (those named like the operator's are replaced); an empty table gives no row.
"""
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.columns import free

#: The templates, short public notices; <...> marks a free place.
TEMPLATES = {
    "AGPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
    "as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Reserved": "Copyright <year> <holder>. All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words that make a sentence a candidate.
TRIGGER = r"(?i)licen[cs]|copyright|©|all rights reserved|public domain|permission (?:is|to)|redistribution"

#: Words whose presence on one side only rules a template out.
DECISIVE = re.compile(
    r"\d|^v$|^(?:gnu|gpl|agpl|lgpl|affero|lesser|apache|mit|bsd|isc|mozilla|mpl|cc|cc0|by|nc|nd|sa|by-nc|by-sa|by-nd|by-nc-sa|by-nc-nd|noncommercial|"
    r"noderivatives|sharealike|not|no|public|domain|reserved)$")
LEAST_REDUCTION, MOST_FREE = 0.15, 4
#: Words of the windows that locate templates in paragraphs.
GRAM = 3
LEVEL = 19

FOUND = "block_no int, start int, end int, block string, template string, reduction double, n_differences int, differences array<string>, confirmed boolean"


#: What parts paragraphs, and their words; both read any text in linear time.
BLANK = re.compile(r"\n(?:[^\S\n]*+\n)++|\Z")
WORDING = re.compile(r"\w(?:[\w./-]*\w)?")


def wording(text: str) -> list[str]:
    return re.findall(r"<\w+>|[\w./-]*\w", text.lower())


class Templates(dict):
    """The verdict on a block, remembered within a task."""

    def __init__(self, templates: dict[str, str]):
        import zstandard

        super().__init__()
        self.words = {name: wording(t) for name, t in templates.items()}
        self.grams: dict[tuple, dict[str, list[int]]] = {}
        self.least = {}
        for name, w in self.words.items():
            places = [k for k in range(len(w) - GRAM + 1) if not any(x.startswith("<") for x in w[k : k + GRAM])]
            # A changed word spoils GRAM windows at most.
            self.least[name] = max(1, len(places) - GRAM * MOST_FREE)
            for k in places:
                self.grams.setdefault(tuple(w[k : k + GRAM]), {}).setdefault(name, []).append(k)
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given = {
            name: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, t in templates.items()
        }

    def differences(self, name: str, block: list[str]) -> tuple[list[str], bool]:
        """Changed words (-template, +block), and whether all of them are free."""
        template, changed, free = self.words[name], [], True
        for kind, a, b, c, d in SequenceMatcher(None, template, block, autojunk=False).get_opcodes():
            if kind == "equal":
                continue
            place = any(w.startswith("<") for w in template[a:b])
            changed += ["-" + w for w in template[a:b] if not w.startswith("<")] + ["+" + w for w in block[c:d] if not place]
            free &= place or not any(DECISIVE.search(w) for w in template[a:b] + block[c:d])
        return changed, free

    def located(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """(template, first word, word behind the last) of the runs of words that may be a template."""
        # Per template: first place and its place in the template, last ones, number of windows.
        open_: dict[str, tuple] = {}

        def span(name: str, found: tuple) -> Iterator[tuple[str, int, int]]:
            p, q, p_last, q_last, n = found
            if n >= self.least[name]:
                yield name, max(0, p - q), min(len(words), p_last + len(self.words[name]) - q_last)

        for p, gram in enumerate(zip(*(words[k:] for k in range(GRAM)))):
            for name, places in self.grams.get(gram, {}).items():
                before = open_.get(name)
                if before:
                    first, first_q, p_last, q_last, n = before
                    on = [q for q in places if q > q_last and abs((p - q) - (p_last - q_last)) <= MOST_FREE]
                    if on:
                        q = min(on, key=lambda q: abs((p - q) - (p_last - q_last)))
                        open_[name] = first, first_q, p, q, n + 1
                        continue
                    yield from span(name, before)
                open_[name] = p, places[0], p, places[0], 1
        for name, found in open_.items():
            yield from span(name, found)

    def spans(self, text: str) -> Iterator[tuple[int, int, tuple]]:
        """(start, end, verdict) of the confirmed templates in the paragraphs of a text."""
        begin = 0
        for blank in BLANK.finditer(text):
            found = list(WORDING.finditer(text, begin, blank.start()))
            begin = blank.end()
            words = [m[0].lower() for m in found]
            for name, a, b in self.located(words):
                changed, free = self.differences(name, words[a:b])
                if free and len(changed) <= MOST_FREE:
                    start, end = found[a].start(), found[b - 1].end()
                    end += text[end : end + 1] == "."
                    raw = " ".join(text[start:end].split()).encode()
                    reduction = 1 - len(self.given[name].compress(raw)) / len(self.alone.compress(raw))
                    yield start, end, (name, reduction, len(changed), changed, True)

    def __missing__(self, block: str):
        raw = block.encode()
        # Frames carry a fixed header, which both sizes share.
        alone = len(self.alone.compress(raw))
        reduced = {name: 1 - len(c.compress(raw)) / alone for name, c in self.given.items()}
        words, best = wording(block), None
        for name in sorted(reduced, key=lambda n: (-reduced[n], n)):
            if reduced[name] < LEAST_REDUCTION:
                break
            changed, free = self.differences(name, words)
            entry = (not (free and len(changed) <= MOST_FREE), -reduced[name], len(changed), name, changed)
            best = entry if best is None or entry < best else best
        value = best and (best[3], -best[1], best[2], best[4], not best[0])
        if len(self) < 50_000 and len(block) <= 1000:
            self[block] = value
        return value


def blocks(text: str, trigger) -> Iterator[tuple[int, str]]:
    """(start, sentence) of the candidates."""
    for line in re.finditer(r"[^\n]+", text):
        if trigger.search(line[0]):
            for part in re.finditer(r".+?(?:[.!?](?=\s+[A-Z])|$)", line[0]):
                if trigger.search(part[0]):
                    lead = len(part[0]) - len(part[0].lstrip())
                    yield line.start() + part.start() + lead, part[0].strip()


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per candidate block with a likely template: `docs` without the text, and FOUND."""
    marked = free(docs, "_f", *(f.split()[0] for f in FOUND.split(", "))).where(F.col(text).rlike(TRIGGER))

    @F.pandas_udf(f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in FOUND.split(', '))}>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        verdicts, trigger = Templates(templates), re.compile(TRIGGER)
        for batch in batches:
            out = []
            for t in batch:
                found = [(start, start + len(block), verdicts[block]) for start, block in blocks(t, trigger)]
                sure = [f for f in found if f[2] and f[2][4]]
                # A notice that a sentence has shown is not repeated.
                spans = [s for s in verdicts.spans(t) if not any(s[2][0] == f[2][0] and s[0] < f[1] and f[0] < s[1] for f in sure)]
                found = [f for f in found if f[2] is None or f[2][4] or not any(s[0] < f[1] and f[0] < s[1] for s in spans)]
                out.append([
                    dict(block_no=no, start=start, end=end, block=t[start:end], template=v[0], reduction=round(v[1], 6), n_differences=v[2], differences=v[3], confirmed=v[4])
                    for no, (start, end, v) in enumerate(sorted(found + spans, key=lambda f: f[:2])) if v])
            yield pd.Series(out)

    found = marked.withColumn("_f", F.explode(look(F.col(text)))).drop(text)
    return found.withColumns({f.split()[0]: F.col(f"_f.{f.split()[0]}") for f in FOUND.split(", ")}).drop("_f")
