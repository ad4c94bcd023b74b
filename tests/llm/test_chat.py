import hashlib
from collections import defaultdict

import pytest

from leakscan.llm import chat

SF = "/root/testdata/sf0.001"


def test_escape_is_reversible_and_breaks_controls():
    for t in ["", "\\", "<|end|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<<SYS>><|im_start|><|im_end|>\\\\<s>", "<<s>", "a\\b\\\\c<"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_language():
    m = [{"role": "user", "text": " Hi ", "turn": 0}, {"role": "assistant", "text": "yo", "turn": 1}]
    r = chat.compile_template("{# note #}{% set x = 'a' + 'b' %}{% for m in messages %}{{ x if loop.first else 'z' }}{{ loop.index }}"
                              "{% if m.role == 'user' and not loop.last %}U{{ m['text'] | trim | upper }}{% elif 1 == 2 %}never"
                              "{% else %}{% generation %}{{ m.text ~ 1 }}{% endgeneration %}{% endif %};{% endfor %}")
    assert r(m) == ("ab1UHI;z2yo1;", [(9, 12)])


def test_segments_hold_whole_turns_and_read_once():
    m = [{"role": ["user", "assistant"][k % 2], "text": "x" * (k % 7), "turn": k} for k in range(50)]
    whole, spans = chat.compile_template(chat.TEMPLATE)(m)
    got = list(chat.compile_segments(chat.TEMPLATE, 100)(iter(m)))
    assert len(got) > 5 and all(100 <= len(t) < 200 for _, t, _ in got[:-1])
    assert "".join(t for _, t, _ in got) == whole and [a for a, _, _ in got] == [sum(len(t) for _, t, _ in got[:k]) for k in range(len(got))]
    assert [(a + x, a + z) for a, _, own in got for x, z in own] == spans
    assert all(t.startswith("<|turn|>") and t.endswith("<|end|>\n") for _, t, _ in got)


def test_templates_of_several_loops_see_all_turns():
    m = [{"role": "user", "text": c, "turn": 0} for c in "abc"]
    source = "<{% for m in messages %}{{ m.text }}{% endfor %}|{% for m in messages %}{% for o in messages %}{{ o.text }}{% endfor %}{% endfor %}>"
    assert "".join(t for _, t, _ in chat.compile_segments(source, 2)(iter(m))) == "<abc|abcabcabc>" == chat.compile_template(source)(m)[0]
    assert [t for _, t, _ in chat.compile_segments("{% if 'a' == 'a' %}no loop{% endif %}", 2)(iter(m))] == ["no loop"]


def test_constant_folding():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}{{ y }}{% endif %}"))
    assert tree == ("block", [("print", ("const", "abcd"))])


@pytest.mark.parametrize("bad", ["{% for m in x %}{% endfor %}", "{{ m.__class__ }}", "{{ f(1) }}", "{{ 'a' | eval }}", "{% if x %}", "{% endif %}",
                                 "{{ messages.append }}", "{% include 'x' %}", "{{ 1 +  }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)([{"role": "a", "text": "b", "turn": 0}])


def want(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, ts in convs.items():
        ts.sort()
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        out.append((c, len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(df):
    d = chat.digests(chat.format_conversations(df))
    return sorted((tuple(r)[:5] for r in d.collect()), key=repr)


def test_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert run(df) == want([tuple(r) for r in df.collect()])


def test_segments_give_the_same_in_any_order(spark):
    """A conversation with a third of all turns, cut into many segments and dealt again."""
    rows = [(7 if k % 3 == 0 else k, k // 2, ["user", "assistant"][k % 2], f"text {k} </s> \\") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_conversations(df, limit=200)
    most = parts.groupBy("conv_id").count().where("conv_id = 7").collect()[0]["count"]
    assert most > 100
    for d in (chat.digests(parts, ordered=True), chat.digests(parts.repartition(5, "part"))):
        assert sorted((tuple(r)[:5] for r in d.collect()), key=repr) == want(rows)


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (1, 2, "assistant", ""), (2, 1, "assistant", "</s>" * 9),
            (2, 1, "assistant", "<|turn|>\\"), (None, 0, "user", "q"), (3, 0, "assistant", "l <|end|>\n" * 50000)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, n_turns int")
    assert run(df) == want(rows)
    assert run(df.limit(0)) == []
