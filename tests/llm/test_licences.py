import re

from riskloom.llm.licences import BASE, detect, outermost, scan_licences
from riskloom.llm.signatures import rules
from tests.llm.helpers import AWKWARD, reports

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), sorted((k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())


def test_base_phrases_are_found_wherever_their_words_follow():
    for text in (
        "CC BY", "cc-by cc\n\nby", "acc by", "cc bye", "ccby", "é cc by ü", "all all rights reserved.", "All / Rights * RESERVED all rights reserved",
        "GNU General Public License, version 3", "general public licensee", "Übergeneral public license", "cc by " * 3000, None, "",
    ):
        n, found = detect(text)
        assert (n, sorted((d["word"], d["label"]) for d in found if d["base"])) == brute_base(text)


def labels(text):
    return {d["label"] for d in detect(text)[1] if not d["base"]}


def test_rules():
    assert len(rules()) > 300 and len({r.name for r in rules()}) == len(rules())
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0"}
    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("SPDX-License-Identifier: GPL-3.0-only") == {"gpl-3.0"}
    assert labels("licensed under the GNU General Public License, version 3.") == {"gpl-3.0"}
    assert labels("GNU Lesser General Public License v2.1 or later") == {"lgpl"}
    assert labels("Licensed under CC BY-NC-SA 4.0") == {"cc-by-nc-sa"}
    assert labels("https://creativecommons.org/licenses/by-nc/4.0/") == {"cc-by-nc"}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == {"mit"}
    assert labels("Copyright (c) 2019") == {"copyright"}
    assert labels("mit der Leitung; apaches; limited permits") == set()


def test_containment_and_priority():
    assert sorted(outermost([(6, 5, 9, 1), (2, 0, 20, 2), (6, 15, 30, 3), (6, 16, 20, 4), (6, 16, 20, 5), (1, 17, 18, 6)])) == [(0, 20, 2), (15, 30, 3), (17, 18, 6)]
    many = [(6, k, k + 3, 0) for k in range(0, 200_000, 2)]
    assert len(outermost(many)) == 100_000


def test_awkward_rows(spark):
    got = scan_licences(reports(spark, AWKWARD + [(50, "All rights reserved. MIT License")])).collect()
    assert len(got) == len(AWKWARD) + 1
    for r in got:
        if r.report_id == 50:
            assert 0.5 < r.score < 1 and r.n_words == 5
        else:
            assert r.score == 0 and r.detections == []
    assert scan_licences(reports(spark, [])).collect() == []
