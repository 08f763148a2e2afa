"""Secret spans against Python's re over whole texts."""

import random
import re

import pytest

from millrace.llm import secret_scan as S

PY = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in S.RULES]
HEX = re.compile("[0-9a-f]+")


def brute(text):
    out = []
    for k, (rule, pattern) in enumerate(zip(S.RULES, PY)):
        for m in (HEX if rule.kind == "hex" else pattern).finditer(text or ""):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_queries():
    words = lambda *w: tuple(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in w)
    assert S.trigram_query(S.RULES[0].pattern) == [words("api_key", "apikey", "passwd", "password", "secret", "token")]
    assert S.trigram_query(S.RULES[1].pattern) == [words("akia")]
    assert S.trigram_query(S.RULES[2].pattern) == []
    assert S.trigram_query(S.RULES[6].pattern) == [words("-----begin "), words("private key-----")]
    assert S.trigram_query("(abc|xy)z+") == []
    assert S.trigram_query("[0-9]+abcd(e|f)x?") == [words("abcde", "abcdf")]


def test_candidates_have_all_runs(docs_of):
    rules = {0: S.trigram_query("hello[0-9]*(wor|war)ld"), 1: S.trigram_query("abc")}
    docs = docs_of([(k, t) for k, t in enumerate(["hello", "hello world", "HELLO warld", "hello world abc", "abc", "hell o world", None, "hello world"])])
    index = S.index_of(docs, S.grams_of(list(rules.values())))
    assert index.postings.count() == index.postings.distinct().count()
    assert sorted(r.rules for r in S.candidates(index, rules).collect()) == [1, 1, 2, 3]


def test_an_index_answers_other_rules(docs_of):
    docs = docs_of([(1, "xx foobar1 yy"), (2, "foo bar"), (3, "quux7"), (4, None)])
    index = S.index_of(docs, ["foo", "oba", "bar", "oob"])
    rules = (S.Rule("a", "foobar[0-9]", 1), S.Rule("b", "quux[0-9]", 1), S.Rule("c", "foo[x-z ]+bar", 1))
    assert [len(S.known_runs(S.trigram_query(r.pattern), index.grams)) for r in rules] == [1, 0, 2]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in S.scan(docs, rules=rules, index=index).collect()}
    assert got == {1: [(3, 0, 10)], 2: [(0, 2, 7)], 3: [(0, 1, 5)], 4: []}


@pytest.mark.parametrize("rows", [0, 1 << 20])
def test_many_candidates_are_joined(docs_of, monkeypatch, rows):
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
    got = S.scan(docs_of([(1, "token=abcdef"), (2, "nothing"), (1, "token=abcdef")])).collect()
    assert sorted((r.doc_id, len(r.spans)) for r in got) == [(1, 1), (1, 1), (2, 0)]


def texts():
    rng = random.Random(5)
    parts = ["password", "PASSWD", "Secret", "toKen", "token", "api_key", "apikey", "API_Key", '"', "'", " ", "  ", ":", "=", "x", "é", "🙂", "abc123", "A" * 7, "AKIA", "AKIA" + "B" * 16, "AKIA" + "B" * 15, "a" * 23, "f0" * 12, "F0" * 12, "\n", "ſecret", "ghp_" + "a" * 36, "AIza" + "b" * 35, "xoxb-123456789-a", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdef"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    return [None, "", *out, *out[:5], "token=" + "a" * 50000 + " " + "secret: abcdef " * 300]


def test_scan(docs_of):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts())]
    got = S.scan(docs_of(rows))
    assert set(got.columns) >= {"doc_id", "key", "line", "spans"}
    got = sorted((str(r.doc_id), r.text or "", [tuple(s) for s in r.spans]) for r in got.collect())
    assert got == sorted((str(i), t or "", brute(t)) for i, t in rows)
    assert S.scan(docs_of([])).count() == 0


def test_no_python(docs_of, capsys):
    S.scan(docs_of([(1, "token=abcdefg")])).explain()
    assert "Python" not in capsys.readouterr().out


@pytest.mark.parametrize("text, spans", [("token=abcde", []), ("token=abcdef", [(0, 0, 12)]), ("é token : 'abcdef'", [(2, 0, 17)])])
def test_small(docs_of, text, spans):
    assert [tuple(s) for s in S.scan(docs_of([(1, text)])).first().spans] == spans
