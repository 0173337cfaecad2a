import random
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

from millrace.llm import chat, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, segment long, whole boolean, formatted string"
NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> <s", "[ROLE]user[/ROLE]", "<", "[", "\\", "<<SYS>>", "<<\\SYS>>", "<\\<SYS>>", "/s>", "SYS>>", "", "plain", "é\U0001f642\n", "[\\INST][INST"]


def test_any_text_comes_back():
    rng, template = random.Random(1), chat.Template()
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[/ROLE]", "a<s>"]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(5)))) for _ in range(rng.randrange(1, 6))]
        string, spans = template.render(turns)
        assert template.turns(string) == turns
        assert [template.unescape(string[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert template.render([("user", "plain")])[0] == "[INST]plain[/INST]"  # ordinary texts stay as they are


def test_strings_outside_the_grammar():
    template = chat.Template()
    for s in ("x", "[INST]a", "[INST]a</s>", "[INST]a[/INST]b", "[/INST]", "[ROLE]a", "[ROLE]a[/TURN]", "[ROLE]a[/ROLE]b[/INST]"):
        with pytest.raises(chat.NotInGrammar):
            template.parse(s)
    for pairs in ((("user", "<a>", "<a>"),), (("user", "ab", "bc"),), (("user", "a\\b", "cd"),)):
        with pytest.raises(ValueError):
            chat.Template(pairs=pairs)


def plain(rows):
    of = defaultdict(list)
    for r in rows:
        of[r[0]].append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    out = {}
    for conv, turns in of.items():
        turns = [(r, t) for _, r, t in sorted(turns, key=lambda x: x[:2])]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(chat.Template().render(turns)[0]))
    return out


def odd_turns():
    rows = [(c, t, ["user", "assistant", "tool", None][t % 4], NASTY[(c + t) % len(NASTY)]) for c in range(40) for t in range(c % 7)]
    rows += [(None, t, "user", f"no id {t}") for t in range(1300)] + [(77, t, "assistant", f"{t} </s>" * 50) for t in range(2000)]
    rows += [(50, None, "user", "no number"), (50, 1, "assistant", None), (51, 1, "user", "twice"), (51, 1, "user", "twice"), (52, 0, "assistant", "long " * 300_000)]
    return rows


@pytest.mark.parametrize("most", [512, 3])
def test_odd_rows_and_long_conversations(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "MAX_TURNS", most)
    rows = odd_turns()
    table = spark.createDataFrame([(*r, 1, True, "x") for r in rows], SCHEMA).repartition(5)
    found = [tuple(r) for r in chat.round_trip(table).collect()]
    assert len(found) == len({r[0] for r in found})
    assert {r[0]: r[1:] for r in found} == plain(rows)
    assert chat.round_trip(table.limit(0)).count() == 0
    strings = chat.format_rows(table).where("conv_id = 77")
    assert strings.count() >= 4 and strings.where("whole").count() == 0


def test_query_has_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.oracle_sql()["op11_chat"])
    columns = [c[0] for c in want.description]
    found = queries.op11_chat(spark, SF).select(*columns).collect()
    assert sorted(tuple(r) for r in found) == sorted(want.fetchall())
