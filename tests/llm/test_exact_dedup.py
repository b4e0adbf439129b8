import hashlib
import re

from tradewind.llm.exact_dedup import exact_dedup

from .conftest import by_id


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", text or ""), []).append((-len(text or ""), doc_id))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            out[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_against_grouping_by_text(make, rng):
    texts = ["a b", "ab", " a\tb\n", "A b", "", None, "\r\n\x0b\x0c ", "ñ x", "ñx", "x" * 200_000, "x" * 199_999 + " x"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(["copy of copies", "copy  of copies", "copyof copies "])) for i in range(300)]
    rows += [(1000 + i, "same beginning " * 10 + str(i % 7)) for i in range(40)]
    got = {k: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for k, r in by_id(exact_dedup(make(rows))).items()}
    assert got == brute(rows)


def test_repeated_and_missing_ids(make):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(
        make([(1, "t t"), (1, "t t"), (1, "tt"), (None, "u"), (2, "u")])).collect()), key=str)
    assert got == [(1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (2, None, 2, False), (None, None, 2, True)]
    assert exact_dedup(make([])).collect() == []


def test_writes_no_files_and_shuffles_texts_once(make, spark, capsys):
    import tradewind.session as session

    before = list(session._WRITTEN)
    found = exact_dedup(make([(i, "many copies" if i % 3 else f"text {i}") for i in range(300)]))
    assert len(found.collect()) == 300 and session._WRITTEN == before
    found.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "Exchange rangepartitioning" in line]
    assert ["ReusedExchange" in line for line in dealt] == [False, True], plan
