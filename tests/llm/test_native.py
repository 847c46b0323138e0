"""URL filters and chat formatting against plain Python."""

import random
import re

import pytest

from tsloom.llm import chat, url_filters


def judged(url, rules):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[2]) if m else ""
    path = m[3] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    rng = random.Random(3)
    rules = [*url_filters.RULES, ("allow", "a.example.net", "/"), ("block", "a.example.net", "/en/x"), ("block", "x.y.z", ""), ("allow", "y.z", "/q/"), ("block", "z", "/q/w/e")]
    hosts = ["net", "NET", "example.net", "A.Example.net", "b.a.example.net", "notexample.net", "example.com", "www.example.com", "org", "x.org", "xorg", "x.y.z", "w.x.y.z", "y.z", "z", "", "a..net", ".net", "[::1]", "example.net:80", "é.net"]
    paths = ["", "/", "/en/", "/en", "/en/xyz", "/de/a", "/fr/", "/q/w/e", "?q=/en/", "#/en/", "/en/?a#b", "/EN/"]
    urls = [f"{s}://{h}{p}" for h in hosts for p in paths for s in ("http", "")] + [None, "", "nothing", "http:/x", "a://b://c/d", "://net/", "http://net/\nx"]
    rows = [(i if i % 50 else None, u) for i, u in enumerate(urls)] + [(1, urls[1])] * 5 + [(7, "http://hot.example.net/en/1")] * 300
    rng.shuffle(rows)
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, rule string, key int")
    got = sorted((tuple(r) for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, rules)).collect()), key=str)
    assert got == sorted(((i, *judged(u, rules)) for i, u in rows), key=str)
    assert url_filters.judge_urls(pages.limit(0), url_filters.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, [])).collect()} == {"allow"}
    plan = url_filters.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


ODD = ["", "plain", "<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|", "a<", "\\|", "line\nbreak\n", "é你", "<", "|>", "<|<|im_end|>\n<|im_start|>user\nhi"]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "sys\ntem", "<|r|>", "back\\nslash", None][(c + t) % 6], ODD[(c * 7 + t) % len(ODD)] if (c + t) % 9 else None) for c in range(30) for t in range(12)]
    rows += [(100, t, "assistant" if t % 2 else "user", f"m{t}") for t in range(1500)] + [(None, 0, "user", "x"), (5, 3, "assistant", "same turn"), (5, 3, "assistant", "same turn"), (6, None, "assistant", "no turn")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.parse(chat.format_chats(chat.events_of(df))).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in want]
        assert [t.loss for t in got[c].turns] == [r == "assistant" for _, _, r, _ in want]
        assert got[c].formatted.count("<|im_start|>") == len(want)
    assert chat.format_chats(chat.events_of(df.limit(0))).count() == 0
    plan = chat.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_events_fold(spark):
    log = [
        (1, 1, 0, 1, "message", "user", "hi"), (1, 2, 1, 1, "delta", "assistant", "he"), (1, 3, 1, 1, "delta", None, "llo"), (1, 4, 2, 1, "message", "user", "more"), (1, 5, 3, 1, "delta", "assistant", "old"),
        (1, 6, 1, 1, "regenerate", None, None), (1, 7, 1, 1, "delta", None, "new"), (1, 8, 1, 1, "delta", None, "er"), (1, 9, 2, 1, "message", "user", "again"), (1, 10, 2, 1, "edit", None, "again!"),
        (2, 1, 0, 1, "message", "user", "gone"), (2, 2, 0, 1, "delete", None, None), (2, 3, 1, 1, "edit", None, "edited only"), (3, 1, 0, 1, "message", "user", "kept"), (None, None, 0, 1, "message", "user", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, part int, kind string, role string, text string")
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in chat.fold(df).collect()), key=str)
    assert got == sorted([(1, 0, "user", "hi"), (1, 1, "assistant", "newer"), (1, 2, "user", "again!"), (3, 0, "user", "kept"), (None, 0, "user", "")], key=str)


def replayed(log):
    """The log one event after the other: {(conversation, turn, part): (role, text)}."""
    state = {}
    for conv, _, turn, part, kind, role, text in sorted(log, key=lambda e: (str(e[0]), e[1])):
        if kind == "regenerate":
            for key in [k for k in state if k[0] == conv and k[1] > turn]:
                del state[key]
        m = state.setdefault((conv, turn, part), {"gone": True, "role": "", "text": ""})
        if kind == "message":
            m |= {"gone": False, "role": role or "", "text": text or ""}
            continue
        m["role"] = m["role"] or role or ""
        if kind == "delta":
            m |= {"gone": False, "text": m["text"] + (text or "")}
        elif kind == "edit":
            m["text"] = text or ""
        elif kind == "regenerate":
            m |= {"gone": False, "text": ""}
        else:
            m |= {"gone": True, "text": ""}
    return {k: (m["role"], m["text"]) for k, m in state.items() if not m["gone"]}


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_against_replay(spark, seed):
    rng, log = random.Random(seed), []
    for conv in [*range(25), None]:
        for seq in range(rng.randint(1, 60)):
            kind = rng.choice(["message", "message", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            log.append((conv, seq, rng.randint(0, 6), rng.choice([1, 1, 2]), kind, rng.choice([None, "user", "assistant"]), rng.choice([*ODD, None])))
    rng.shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, part int, kind string, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn, r.part): (r.role, r.text) for r in chat.fold(df).collect()}
    want = replayed(log)
    assert got == want and len(want) > 50
    turns = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in chat.parse(chat.format_chats(df)).collect()}
    for conv in {k[0] for k in want}:
        assert turns[conv] == [(*want[k], want[k][0] == "assistant") for k in sorted((k for k in want if k[0] == conv), key=lambda k: k[1:])]


def test_very_long_texts_and_urls(spark):
    text = "<|" * 200_000
    df = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", "")], "conv_id long, turn long, role string, text string")
    r = chat.parse(chat.format_chats(chat.events_of(df))).first()
    assert [(t.role, t.text) for t in r.turns] == [("assistant", text), ("user", "")]
    urls = [(1, "http://" + "a." * 500 + "net/" + "x" * 100_000), (2, "http://example.com/de/" + "y" * 100_000)]
    got = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in url_filters.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), url_filters.rule_table(spark)).collect()}
    assert got == {1: ("net/", "block", 100_001), 2: ("example.com/de/", "block", 100_004)}


def test_a_hot_host_over_many_sweeps(spark):
    """5,000 urls of one host, 40 nested rules, a row that occurs 3,000 times."""
    rng = random.Random(8)
    rules = [("block" if k % 2 else "allow", rng.choice(["hot.example", "example", "a.hot.example"]), "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))) for k in range(40)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    rows = [(k, "http://" + rng.choice(["hot.example", "hot.example", "b.a.hot.example", "x.org"]) + "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for k in range(5000)] + [(7, "http://hot.example/a/b/c")] * 3000
    got = sorted((tuple(r) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(4), url_filters.rule_table(spark, rules)).collect()), key=str)
    assert got == sorted(((i, *judged(u, rules)) for i, u in rows), key=str)
