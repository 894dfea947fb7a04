"""Candidates, their merge, ranks and budgets against plain loops over the same files."""

import random
import time

from corpusloom.operators import candidates as C
from corpusloom.operators import markdown

WEIGHT = {"constitution": 100, "target": 100, "parent": 90, "depends_on": 90, "supersedes": 90, "wikilink": 80, "backlink": 65, "text_match": 0}


def split_units(text):
    lines, out, buf, filled, fence = text.split("\n"), [], "", False, ""
    for k, line in enumerate(lines):
        buf += line + ("\n" if k < len(lines) - 1 else "")
        mark = line.lstrip(" \t")[:3]
        mark = mark if mark in ("```", "~~~") else ""
        inside = bool(fence) or bool(mark)
        fence = "" if fence and mark == fence else fence or mark
        if inside or line.strip():
            filled = True
        elif filled:
            out.append(buf)
            buf, filled = "", False
    return [*out, buf] if buf else out


def tokens(text):
    return (len(text) + 3) // 4


def test_units(spark):
    rng = random.Random(4)
    texts = ["", "a", "a\n", "\n\na\n\n\nb", "```\n\nx\n\n```\n\ny"] + ["\n".join(rng.choice(["", " \t", "a b", "c", "```", "~~~", "  ```x"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, t string")
    got = {r["id"]: r["u"] for r in df.select("id", markdown.units(df["t"]).alias("u")).collect()}
    assert got[-1] == [] and all(got[i] == split_units(t) and "".join(got[i]) == t for i, t in enumerate(texts))


def fill(items, budget, hard):
    used, out, must = 0, [], 0
    for position, tier, text in items:
        n, units = tokens(text), split_units(text)
        if tier == 0:
            must, used = must + n, used + n
            out.append((position, True, text, n, None))
        elif used + n <= budget:
            used += n
            out.append((position, True, text, n, None))
        else:
            part, room = "", budget - used
            took = 0
            for u in units:
                if took + tokens(u) > room:
                    break
                part, took = part + u, took + tokens(u)
            used += took
            out.append((position, True, part, took, None) if took else (position, False, None, 0, "no_coherent_unit_fit" if len(units) > 1 else "did_not_fit_remaining_budget"))
    return out, max(0, must - hard)


def test_budget(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for r in range(30):
        items = []
        for k in range(rng.randint(1, 9)):
            text = "\n\n".join("w" * rng.randint(1, 60) for _ in range(rng.randint(0, 4))) or rng.choice(["", "x" * 90])
            items.append((k + 1, 0 if k < rng.randint(0, 2) else rng.randint(1, 4), text))
        rows += [(str(r), p, f"f{p}.md", f"h{p}", t, p, p + 1, tier) for p, tier, t in items]
        want[str(r)] = fill(items, 40, 12)
    df = spark.createDataFrame(rows, "request string, position int, path string, heading string, content string, start_line int, end_line int, tier int")
    out = C.filled(df, 40, 12)
    got = {}
    for x in sorted(out.collect(), key=lambda x: x["position"]):
        got.setdefault(x["request"], []).append((x["position"], x["kept"], x["content_kept"], x["used"], x["exclusion"]))
        assert (x["overage"], x["limit_exceeded"]) == (want[x["request"]][1], want[x["request"]][1] > 0)
    assert got == {r: items for r, (items, _) in want.items()}
    for d in C.diagnostics(out, 12).collect():
        items = want[d["request"]][0]
        total = sum(tokens(t[4]) for t in rows if t[0] == d["request"])
        chosen = sum(i[3] for i in items)
        assert (d["candidates_considered"], d["items_selected"], d["tokens_available"], d["tokens_selected"], d["exclusions"]) == (len(items), sum(i[1] for i in items), total, chosen, sum(not i[1] for i in items))
        assert abs(d["reduction_percent"] - ((total - chosen) / total * 100 if total else 0)) < 1e-9
    assert {x["kept"] for x in C.filled(df.where("tier > 0"), -5, 0).where("content <> ''").collect()} == {False}


FILES = {
    "c.md": "# Law\nbe good", "s/1.md": "# One {#one}\nretry text\n## Requirements {#req}\nR1\n### Deep {#deep}\nretry deep", "s/2.md": "pre\n# Two {#two}\n\n## Sub {#sub}\n#### Low {#low}\nlow body",
    "s/3.md": "# Three\nthree\n", "s/4.md": "# Four\nretry retry four", "s/5.md": "nothing",
}
IDS = {f"S{k}": f"s/{k}.md" for k in range(1, 6)}
REFS = [("S1", "S2", "parent", 0, "", 0, ""), ("S1", "S3", "depends_on", 1, "", 0, ""), ("S1", "S2", "wikilink", 2, "One", 2, "low"), ("S1", "S2", "wikilink", 3, "Requirements", 4, "nowhere"), ("S1", "S4", "wikilink", 4, "One", 2, ""), ("S1", "S2", "wikilink", 5, "One", 2, "sub"),
        ("S3", "S1", "depends_on", 0, "", 0, ""), ("S4", "S1", "wikilink", 0, "Four", 2, "one"), ("S2", "S5", "parent", 0, "", 0, ""), ("S3", "S4", "wikilink", 1, "Three", 2, ""), ("S4", "S5", "wikilink", 1, "Four", 2, ""), ("S4", "S1", "supersedes", 2, "", 0, "")]


def sections_of(text):
    out, ls = [], text.split("\n")
    heads = [i for i, x in enumerate(ls) if x.startswith("#")]
    for k, i in enumerate(([0] if not heads or heads[0] else []) + heads):
        ends = [h for h in heads if h > i]
        end = ends[0] if ends else len(ls)
        title = ls[i].lstrip("#").strip() if i in heads else ""
        anchor = title[title.index("{#") + 2 : -1] if "{#" in title else ""
        body = "\n".join(ls[i + 1 if i in heads else i : end])
        out.append({"heading": title.split(" {#")[0], "anchor": anchor, "level": len(ls[i]) - len(ls[i].lstrip("#")) if i in heads else 0, "start": i + 1, "end": end, "body": body.removesuffix("\n")})
    return out


def collect_by_hand(target, hits):
    out = []

    def whole(path, reason):
        out.extend((path, s["start"], s["end"], reason, 0.0, None) for s in sections_of(FILES[path]) if s["body"])

    def follow(refs, make, end):
        for r in refs:
            reason = make(r)
            path = IDS[r[end]]
            if reason[1] == "wikilink" and reason[5]:
                secs = sections_of(FILES[path])
                k = next((k for k, s in enumerate(secs) if s["anchor"] == reason[5]), None)
                if k is not None:
                    up, least = [], secs[k]["level"]
                    for s in secs[:k][::-1]:
                        if least > 1 and 0 < s["level"] < least:
                            up, least = [s["heading"], *up], s["level"]
                    out.append((path, secs[k]["start"], secs[k]["end"], reason, 0.0, up))
            else:
                whole(path, reason)

    of = lambda i, link: [r for r in REFS if r[0] == i and (r[2] == "wikilink") == link]
    to = lambda i, link: sorted([r for r in REFS if r[1] == i and (r[2] == "wikilink") == link], key=lambda r: (r[0], r[3]))
    there = lambda tier: lambda r: (tier, r[2], IDS[r[0]], r[4], r[5], r[6])
    here = lambda r: (2, "backlink", IDS[r[0]], r[4], r[5], r[6])
    whole("c.md", (0, "constitution", "", "", 0, ""))
    whole(IDS[target], (0, "target", "", "", 0, ""))
    follow(of(target, False), there(1), 1)
    follow(of(target, True), there(2), 1)
    follow(to(target, False), here, 0)
    follow(to(target, True), here, 0)
    for i in [r[1] for r in of(target, False) + of(target, True)] + [r[0] for r in to(target, False) + to(target, True)]:
        follow(of(i, False), there(4), 1)
        follow(of(i, True), there(4), 1)
    out += [(p, a, b, (3, "text_match", "", "", 0, ""), rank, None) for p, a, b, rank in hits]
    merged = {}
    for path, start, end, reason, rank, up in out:
        m = merged.setdefault((path, start, end), {"reasons": [], "rank": 0.0, "up": None})
        m["reasons"].append(reason)
        m["rank"] = rank if reason[1] == "text_match" else m["rank"]
        m["up"] = up if m["up"] is None else m["up"]
    for m in merged.values():
        direct = [r for r in m["reasons"] if r[0] != 4]
        m["reasons"] = list(dict.fromkeys(direct or m["reasons"]))
    return merged


def test_sources_merge_and_rank(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    refs = spark.createDataFrame([(a, b, rel, IDS[a], int(a[1]), o, sec, line, anchor) for a, b, rel, o, sec, line, anchor in REFS], "source_id string, target_id string, relation string, source_path string, source_rank int, ord int, source_section string, source_line int, target_anchor string")
    entities = spark.createDataFrame(list(IDS.items()), "id string, path string")
    hits = [("s/4.md", 1, 2, -1.23), ("s/5.md", 1, 1, -9.0), ("c.md", 1, 2, 0.5)]
    text = spark.createDataFrame([("S1", p, "", FILES[p].split("\n")[-1], a, b, rank) for p, a, b, rank in hits], "request string, path string, heading string, content string, start_line int, end_line int, rank double")
    requests = spark.createDataFrame([("S1", "S1"), ("S3", "S3"), ("S9", "S9")], "request string, target string")
    merged = C.merge(C.collect(requests, refs, entities, markdown.sections(files), text, "c.md"))
    out = C.ranked(C.scored(merged, "implementation", ["retry"], prefer_section=True)).collect()
    for target in ("S1", "S3"):
        want = collect_by_hand(target, hits if target == "S1" else [])
        got = {(r["path"], r["start_line"], r["end_line"]): r for r in out if r["request"] == target}
        assert set(got) == set(want)
        rows = []
        for key, m in want.items():
            r, relations = got[key], [x[1] for x in m["reasons"]]
            assert [tuple(x) for x in r["reasons"]] == m["reasons"] and r["heading_path"] == m["up"] and r["text_rank"] == m["rank"]
            words = min(4, (r["heading"] + "\n" + r["content"]).lower().count("retry")) * 10
            relevance = (0 if m["rank"] >= 0 else min(40, int(-m["rank"] * 10))) if "text_match" in relations else words
            score = max(WEIGHT[x] for x in relations) + 5 * bool({"wikilink", "backlink", "text_match"} & set(relations)) + relevance + 15 * any(x[3].lower() == "requirements" for x in m["reasons"])
            assert (r["score"], r["tier"]) == (score, min(x[0] for x in m["reasons"]))
            rows.append((r["tier"], -score, *key))
        assert [r["position"] for r in sorted(got.values(), key=lambda r: (r["tier"], -r["score"], r["path"], r["start_line"]))] == list(range(1, len(rows) + 1))
    # a request whose target isn't there still gets the constitution
    assert {r["path"] for r in out if r["request"] == "S9"} == {"c.md"}
    items = C.package_items(C.filled(C.ranked(C.scored(merged)), 60)).collect()
    assert items and all(i["fingerprint"].startswith("sha256:") and i["used"] == tokens(i["content"]) for i in items)


def test_many_candidates_of_one_request(spark):
    """Time in proportion to the rows: 40,000 of one request, and a chunk with 8,000 reasons."""
    began = time.time()
    df = spark.range(1, 40_001).selectExpr("'a' as request", "cast(id as int) as position", "'f' as path", "'h' as heading", "repeat('w', cast(1 + id % 30 as int)) as content", "cast(id as int) as start_line", "cast(id as int) as end_line", "if(id = 1, 0, 1) as tier")
    want, used = [], 0
    for i in range(1, 40_001):
        t = (1 + i % 30 + 3) // 4
        if i == 1 or used + t <= 60_000:
            used += t
            want.append(i)
    assert [x["position"] for x in C.filled(df, 60_000).where("kept").orderBy("position").collect()] == want
    reason = "named_struct('tier', if(id < 8000, 4, 2), 'relation', 'backlink', 'source_path', cast(id % 8000 as string), 'source_section', '', 'source_line', 0, 'target_anchor', '')"
    many = spark.range(16_000).selectExpr("'a' as request", "array(6L, id) as seq", "'f' as path", "'h' as heading", "'c' as content", "1 as start_line", "2 as end_line", f"{reason} as reason", "0D as text_rank", "cast(null as array<string>) as heading_path")
    (row,) = C.merge(many).collect()
    assert row["tier"] == 2 and [r["source_path"] for r in row["reasons"]] == [str(i) for i in range(8000)]
    assert time.time() - began < 90
