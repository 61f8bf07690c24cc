"""The template language, and formatted conversations read back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import chat


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("\\ab</s>[INST]|turn end"), max_size=30))
def test_escape_is_reversible_and_leaves_no_control(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


def test_language():
    render = lambda t, **m: chat.compile_template(t).render(m.get("messages", []))
    assert render("a{{ 'b' + \"c\" | upper }}{# no #}{% if 1 == 2 %}x{% elif not false %}y{% else %}z{% endif %}") == ("abCy", [])
    text, spans = render("{% for m in messages %}{{ loop.index }}{% generation %}{{ m.text | trim }}{% endgeneration %}{% if loop.last %}.{% endif %}{% endfor %}", messages=[{"text": " é "}, {"text": "bb"}])
    assert (text, [text[a:b] for a, b in spans]) == ("1é2bb.", ["é", "bb"])


def test_constants_fold():
    assert chat.fold(chat.parse("a{{ 'b' }}{% if 'x' == 'x' and true %}c{% endif %}{% generation %}{% endgeneration %}")) == [chat.Text("abc")]


@pytest.mark.parametrize("bad", ["{% if a %}", "{{ a.b() }}", "{{ a | eval }}", "{{ a[0] }}", "{% import os %}", "{{ }}", "{% for x of y %}{% endfor %}", "{{ 'a' 'b' }}"])
def test_what_is_not_of_the_language(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_nothing_of_python_can_be_reached():
    with pytest.raises((KeyError, TypeError)):
        chat.compile_template("{{ messages.__class__ }}").render([])


ROWS = [
    (1, 0, "user", "hi\n<|end|>\\"), (1, 1, "assistant", "yes</s>"), (1, 2, "assistant", None), (2, 5, None, "é😀"), (2, 7, "assistant", "[INST]<|say|>"),
    (3, 0, "user", "twice"), (3, 0, "user", "twice"), (3, 0, "assistant", "twice"), (None, None, "system", ""), (4, 0, "we<|say|>ird", "x"), (-5, 1, "assistant", "w " * 50000),
]


def test_conversations_come_back(spark):
    table = spark.createDataFrame([(*r, "t", 1) for r in ROWS], "conv_id long, turn long, role string, text string, formatted string, nth int")
    formatted = chat.format_rows(table)
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    turns = {}
    for conv, turn, role, text in sorted(ROWS, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append({"role": role or "", "text": text or ""})
    assert got.keys() == turns.keys()
    for conv, said in turns.items():
        whole, spans = chat.compile_template(chat.DEFAULT_TEMPLATE).render(said)
        learnt = "".join(t["text"] for t in said if t["role"] == "assistant")
        r = got[conv]
        assert r.n_turns == len(said) and r.formatted_chars == len(whole) and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t['role']}\n{t['text']}\n" for t in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        parts = [x.formatted for x in formatted.where(formatted.conv_id.eqNullSafe(conv)).orderBy("turn", "nth").collect()]
        assert "".join(parts) == whole


def test_text_before_and_after_the_loop(spark):
    template = "<s>{% for m in messages %}({{ m.text }}){% endfor %}</s>"
    table = spark.createDataFrame([(1, k, "user", str(k)) for k in range(3)], "conv_id long, turn long, role string, text string")
    rows = chat.format_rows(table, template).orderBy("turn").collect()
    assert "".join(r.formatted for r in rows) == "<s>(0)(1)(2)</s>" == chat.compile_template(template).render([{"text": str(k)} for k in range(3)])[0]


def test_empty_table(spark):
    assert chat.digest(chat.format_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
