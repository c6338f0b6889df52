"""Proposals applied by joins against the same proposals applied one after another."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from routeloom.operators import proposals
from routeloom.operators.proposals import APPLIED

ITEMS = "parent string, section int, item int, skill string, target string, keep string, remove string, text string"


def one_by_one(order, skills, members, edits, children, verified):
    """The catalog after the proposals in node order, kept in plain dictionaries."""
    nodes = {n: {s for m, s in members if m == n} for n in order}
    texts, into, patch = dict.fromkeys(order, "old"), dict.fromkeys(skills), []
    told, rewritten, gone = dict.fromkeys(skills, "old"), set(), set()
    for parent in order:
        for e in sorted((e for e in edits if e[0] == parent), key=lambda e: (APPLIED[e[1]], e[2])):
            _, section, item, skill, _, keep, remove, text = e
            if section == 7:
                texts[parent] = text
                patch.append(("rewrite_node", parent, None, None))
            elif section == 2 and skill not in rewritten | gone:
                told[skill] = text
                rewritten.add(skill)
                patch.append(("rewrite_skill", None, None, skill))
            elif section == 3 and skill not in nodes[parent] | gone:
                nodes[parent].add(skill)
                patch.append(("add_edge", parent, None, skill))
            elif section == 4:
                x, y = min(keep, remove), max(keep, remove)
                stays = verified.get((x, y))
                if stays is None or {x, y} & gone or into[x] or into[y]:
                    continue
                other = y if stays == x else x
                into[other] = stays
                gone.add(other)
                for held in nodes.values():
                    if other in held:
                        held.discard(other)
                        held.add(stays)
                patch.append(("merge", None, None, other))
            elif section == 5:
                for _, _, _, name, _ in sorted({(*c[:4], c[4]) for c in children if c[:2] == (parent, item)}, key=lambda c: c[2]):
                    moved = {c[5] for c in children if c[:2] == (parent, item) and c[3] == name} - gone
                    final, k = name, 1
                    while final in nodes:
                        final = f"{parent}_{name}" + ("" if k == 1 else f"_{k}")
                        k += 1
                    nodes[parent] -= moved
                    nodes[final] = moved
                    texts[final] = "Fits"
                    patch += [("split_rewire", parent, final, s) for s in moved]
    return nodes, texts, told, into, patch


@pytest.mark.parametrize("seed", range(4))
def test_revision_equals_one_after_another(spark, seed):
    rng = random.Random(seed)
    order = [f"n{k}" for k in range(6)]
    skills = [f"s{k:02d}" for k in range(14)]
    members = sorted({(n, s) for n in order for s in rng.sample(skills, 6)})
    edits, children = [], []
    for n in order:
        if rng.random() < 0.5:
            edits.append((n, 7, 0, None, None, None, None, f"about {n}"))
        for section, field in ((2, "text"), (3, None), (4, None)):
            for item in range(rng.randint(0, 3)):
                a, b = rng.sample(skills, 2)
                if section == 4:
                    edits.append((n, 4, item, None, None, a, b, None))
                else:
                    edits.append((n, section, item, a, n if section == 3 else None, None, None, f"{a} by {n} {item}" if field else None))
        if rng.random() < 0.7:
            edits.append((n, 5, 0, None, None, None, None, None))
            some = rng.sample(skills, 6)
            name = rng.choice(["kid", f"kid_{n}"])
            children += [(n, 0, 0, name, "Fits", s) for s in some[:3]] + [(n, 0, 1, f"{name}_b", "Fits", s) for s in some[3:]]
    merged = {(min(e[5], e[6]), max(e[5], e[6])) for e in edits if e[1] == 4}
    verified = {p: rng.choice(p) for p in merged if rng.random() < 0.8}
    nodes, texts, told, into, patch = one_by_one(order, skills, members, edits, children, verified)

    judged = {
        "edits": spark.createDataFrame(edits, ITEMS),
        "children": spark.createDataFrame(children, "parent string, item int, child int, name string, description string, skill string"),
    }
    after = proposals.apply_in_order(
        spark.createDataFrame([(s, "old", None) for s in skills], "skill string, description string, merged_into string"),
        spark.createDataFrame([(n, "old", k == 0, k) for k, n in enumerate(order)], "name string, description string, is_root boolean, ord long"),
        spark.createDataFrame([("n0", "n1")], "parent string, child string"),
        spark.createDataFrame([(n, s, k) for k, (n, s) in enumerate(members)], "node string, skill string, pos long"),
        judged,
        spark.createDataFrame([(*p, k) for p, k in verified.items()], "x string, y string, keep string"),
    )
    assert rows(after["members"], "node", "skill") == sorted((n, s) for n, held in nodes.items() for s in held)
    assert dict(rows(after["nodes"], "name", "description")) == texts
    assert dict(map(lambda r: (r[0], r[1:]), rows(after["skills"].na.fill("-"), "skill", "description", "merged_into"))) == {s: (told[s], into[s] or "-") for s in skills}
    log = after["patch"].select("operation", "node", "to_node", "skill").na.fill("-")
    assert rows(log, "operation", "node", "to_node", "skill") == sorted(tuple(x or "-" for x in p) for p in patch)
    counts = dict(rows(proposals.edits_by_operation(after["patch"]), "operation", "n"))
    assert counts == {op: sum(p[0] == op for p in patch) for op in counts}
    assert after["edges"].count() == 1 + len(set(nodes) - set(order))


def test_rejected_proposals_leave_no_edit(spark):
    """One planted fault each; the accepted one keeps its items, minus an edge without its own evidence."""
    import json

    ok = {"parent_rewrite": None, "skill_rewrites": [], "add_edges": [], "merges": [], "splits": []}
    rewrite = {"skill_name": "s1", "replacement_description": "new", "evidence_query_ids": ["1", "2"]}
    edge = {"skill_name": "s1", "target_node": "p", "evidence_query_ids": ["1", "2", "2"]}
    node = {"replacement_description": "about", "evidence_query_ids": [5, 6]}
    faults = {
        None: ok | {"skill_rewrites": [rewrite], "add_edges": [edge], "parent_rewrite": node},
        "json": "{",
        "shape": {"merges": []},
        "item_shape": ok | {"merges": "none"},
        "text": ok | {"parent_rewrite": node | {"replacement_description": " "}},
        "scope": ok | {"skill_rewrites": [rewrite | {"skill_name": "zz"}]},
        "ids": ok | {"skill_rewrites": [rewrite | {"evidence_query_ids": ["1", "9"]}]},
        "unrelated": ok | {"parent_rewrite": node | {"evidence_query_ids": [1, 5]}},
        "children": ok | {"splits": [{"parent_node": "p", "children": [], "evidence_query_ids": [1, 2]}]},
    }
    misses = [("p", "rewrite_skill", "s1", "s1", q) for q in (1, 2)] + [("p", "add_edge", "s2", "p", q) for q in (3, 4)] + [("p", "rewrite_node", "s2", "p", q) for q in (5, 6)]
    for rule, reply in faults.items():
        reply = reply if isinstance(reply, str) else json.dumps(reply)
        got = proposals.judge(
            spark.createDataFrame([("p", reply)], "parent string, reply string"),
            spark.createDataFrame([], "parent string, a string, b string, relation string, support long, a_is_source boolean, b_is_source boolean"),
            spark.createDataFrame([], "parent string, a string, b string, relation string, query_id long"),
            spark.createDataFrame(misses, "parent string, operation string, source string, target string, query_id long"),
            spark.createDataFrame([("p", "s1"), ("p", "s2")], "parent string, skill string"),
            spark.createDataFrame([], "parent string, split_required boolean, minimum_move int"),
            spark.createDataFrame([("p",)], "name string"),
        )
        assert [r.rule for r in got["verdicts"].collect()] == [rule]
        # the edge cites the misses of a rewrite: dropped, and nothing else is
        assert rows(got["edits"], "section") == ([(2,), (7,)] if rule is None else [])
        assert got["cited"].where(F.col("section") == 7).count() == (2 if rule is None else 0)
