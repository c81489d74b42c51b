import re
from itertools import product

try:
    from re import _parser as parser
except ImportError:
    import sre_parse as parser

import pytest

from riskloom.llm.licences import _prepared, detect, _spaced
from riskloom.llm.signatures import _VERSION, rules


def examples(tree):
    """Strings for every alternative and option of a pattern; of repeats none or one, and the longest of a bounded wildcard."""
    parts = []
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "ANY":
            parts.append(["x"])
        elif name == "IN":
            found = [chr(v) for o, v in value if str(o) == "LITERAL"]
            for o, v in value:
                found += [chr(c) for c in range(v[0], v[1] + 1)] if str(o) == "RANGE" else ["2"] if str(o) == "CATEGORY" else []
            parts.append(found)
        elif name == "SUBPATTERN":
            parts.append(examples(value[-1]))
        elif name == "BRANCH":
            parts.append([x for branch in value[1] for x in examples(branch)])
        elif name == "MAX_REPEAT":
            least, _, inner = value
            parts.append(([""] if least == 0 else []) + [x * max(least, 1) for x in examples(inner)])
        else:
            raise AssertionError(name)
    return ["".join(p) for p in product(*parts)]


@pytest.mark.parametrize("number", range(len(rules())))
def test_every_alternative_passes_the_prefilter(number):
    automaton, known = _prepared()
    rule, pattern = known[number]
    for text in examples(parser.parse(rule.pattern.replace("{v}", _VERSION))):
        raw = text.encode("latin-1")
        if "©" not in text and raw.isascii():
            plain = _spaced(text)
            assert pattern.search(raw), (rule, text)
            assert any(number in numbers for _, numbers in automaton.iter(plain)), (rule.name, text)


def labels(text):
    return {d["label"] for d in detect(text)[1] if not d["base"]}


def test_alternatives_without_the_family_name():
    assert labels("Licensed under the Zero Clause BSD license") >= {"0bsd"}
    assert labels("users interacting with it remotely through a computer network") == {"agpl-3.0"}
    assert labels("released under MS-PL") == {"ms-pl"} and labels("the PSF license") == {"python-2.0"}
    assert labels("This must not be copied") == {"proprietary"} and labels("do not copy or distribute") == {"proprietary"}
    assert labels("may not be used to train") == {"opt-out"} and labels("they waive all copyright and related rights") == {"cc0-1.0"}


def test_a_passage_may_run_over_line_ends():
    assert labels("Neither the name of the holder\n nor the names of its\n contributors may be used to endorse or promote products") == {"bsd-3-clause"}
