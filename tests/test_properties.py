"""Properties of the core operators over generated inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tagsieve.sources.tsv import Broken, Descent, parse_one

FIELD = r'("(?:[^"]|"")*"|(?:[^"\t][^\t]*)?)'
LABELS = {"a", "b"}


def judged(line):
    """The same rules as regular expressions over the whole record."""
    cut = line[:-1] if line.endswith("\r") else line
    if not re.fullmatch(rf"{FIELD}(\t{FIELD})*", cut, re.S):
        return "quoting"
    fields = re.fullmatch(rf"{FIELD}\t{FIELD}\t{FIELD}", cut, re.S)
    if not fields:
        return "columns"
    text, gold, noisy = (f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in fields.groups())
    bad = gold not in LABELS or noisy not in LABELS or not text.strip() or re.search("[�\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", text)
    return "value" if bad else (text, gold, noisy)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text('ab"\t\n\r\\ \x00', max_size=14), st.builds("\t".join, st.lists(st.sampled_from(["a", "b", '"a"', 'x"', '"x""y"', '"', "", " ", '"t\tu"']), max_size=5))))
def test_descent_equals_regular_expressions(line):
    found = parse_one(line, LABELS)
    assert (found.reason if isinstance(found, Broken) else (found.texts, found.gold, found.noisy)) == judged(line)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["t\ta\tb", '"t\nu"\tb\ta', "x", '"open\ta\tb', "t\ta\tc", '"q"x\ta\ta', ""]), max_size=9))
def test_recovery_ends_and_loses_no_valid_line(lines):
    source = "\n".join(lines) + "\n"
    found = list(Descent(source, LABELS).records())
    starts = [at for at, _ in found]
    assert starts == sorted(set(starts))
    if all(not line.startswith('"') for line in lines):
        assert sum(not isinstance(x, Broken) for _, x in found) == lines.count("t\ta\tb")
