"""Automata from grammar files, against a backtracking matcher that also tells beginnings."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from weft.plans.grammar import COMPACT, COMPACT_TEXT, LIGHT, LIGHT_TEXT, Grammar

GAP = r"[ \t\n]"
NAME = r':[^ \t\n;,."]+'
VALUE = rf'(?:{NAME}|"[^"]*")'
LIGHT_PATTERN = rf'(?:{GAP}*{NAME}{GAP}+a{GAP}*{NAME}(?:{GAP}*;(?:{GAP}*{NAME}{GAP}*{VALUE}(?:{GAP}*,{GAP}*{VALUE})*)?)*{GAP}*\.)+'
LETTER = "[A-Za-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff_]"
CODE = r"(?:%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])"
FIRST = rf"(?:{LETTER}|[_:0-9]|{CODE})"
COMPACT_NAME = rf":{FIRST}(?:\.*(?:{FIRST}|[-·̀-ͯ‿-⁀]))*"
COMPACT_VALUE = rf'(?:{COMPACT_NAME}|{GAP}?"[ \t!#-\[\]-~]*"{GAP}?)'
VALUES = rf"{COMPACT_VALUE}(?:{GAP}?,{GAP}?{COMPACT_VALUE})*"
COMPACT_PATTERN = rf"(?:{GAP}?{COMPACT_NAME}{GAP}?(?:{COMPACT_NAME}|a){VALUES}(?:{GAP}?;{GAP}?(?:(?:{COMPACT_NAME}|a){GAP}?{VALUES})?)*{GAP}?\.)+"
LINES = [':A_b a :P; :b "c d"; :e :F, :G .', ':Stacey_Fox a:Artist;:birthDate "1965-06-21".', ':%2819%29_VK8 a:Body ; \n :epoch "2006" .', ":Paula a:Person ;:birthPlace:Spain_women\\'s_team. ", ':É :p :x,:y;a :T. :B a:C.', ":a.b a:C.d;:e :f.", ':漢字 a:Ť;:x "🙂".']


def expected(pattern, text):
    def begins(n):
        return regex.fullmatch(pattern, text[:n], partial=True, timeout=5) is not None

    failed = next((n for n in range(len(text)) if not begins(n + 1)), None)
    whole = regex.fullmatch(pattern, text, timeout=5)
    return failed is None, whole is not None, failed


def damaged():
    r, out = random.Random(9), ["", " ", ".", ":"]
    for line in LINES:
        out.append(line)
        for _ in range(12):
            i, j = sorted((r.randrange(len(line) + 1), r.randrange(len(line) + 1)))
            out += [line[:i], line[:i] + r.choice(':;,."\\% aé🙂1') + line[i:], line[:i] + line[i + 1 :], line[:i] + line[min(j, i + 3) :], line + r.choice([".", " ", "x", line])]
    return out


@pytest.mark.parametrize("grammar,pattern", [(LIGHT, LIGHT_PATTERN), (COMPACT, COMPACT_PATTERN)], ids=["light", "compact"])
def test_prefix_acceptance_and_place_of_failure(spark, grammar, pattern):
    texts = damaged()
    want = {t: expected(pattern, t) for t in texts}
    assert sum(w[1] for w in want.values()) > 3 and sum(w[2] is not None for w in want.values()) > 40
    assert {t: grammar.walk(t) for t in texts} == want
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "x string").select("x", grammar.run(F.col("x")).alias("r"))
    got = {r.x: tuple(r.r) for r in df.collect()}
    assert got == want | {None: (False, False, 0)}


def test_automata_are_minimal():
    g = Grammar.read('root ::= ("ab" | "cb")* ("x" | "x")')
    assert len(g.table) == 3 and g.walk("abcbx") == (True, True, None) and g.walk("abc") == (True, False, None) and g.walk("ac") == (False, False, 1)
    assert Grammar.read("root ::= a\na ::= [a-c]\n# a comment\n/* another */") == Grammar.read("root ::= 'a' | #x62 | \"c\"")
    assert Grammar.read(r'root ::= [^"\]-]+').walk('a]')[2] == 1 and Grammar.read(r'root ::= "\"\\\n"').walk('"\\\n')[1]
    assert Grammar.read("root ::= 'a'?").walk("") == (True, True, None)


@pytest.mark.parametrize("text", ["root ::= '(' root ')' | 'x'", "root ::= other", "root ::= 'a", "root ::= ('a'", "'a'", "root ::= * 'a'"])
def test_what_is_no_regular_grammar_raises(text):
    with pytest.raises(ValueError):
        Grammar.read(text)


def test_other_roots_and_texts():
    assert Grammar.read(LIGHT_TEXT, "name").walk(":abc")[1] and Grammar.read(COMPACT_TEXT, "hex").walk("g") == (False, False, 0)


def test_many_texts_are_walked_at_once():
    import pandas as pd

    texts = [":a a :B .", ":a a :B; :c \"é😀\" .x", "", None, ":a", "😀", ":a a :B . " * 50]
    got = LIGHT.walks(pd.Series(texts, dtype=object))
    want = [(False, False, 0) if t is None else LIGHT.walk(t) for t in texts]
    assert [(p, f, None if pd.isna(n) else int(n)) for p, f, n in got.itertuples(index=False)] == want
