import hashlib
from collections import defaultdict

from talkweave.llm import exact, lines


def brute_groups(rows, largest):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = (max(ids) if largest else min(ids)) if ids else None
        out.append((i, keep, len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_equal_brute_force(table, odd_rows):
    rows = [(i, t) for i, t, _ in odd_rows]
    for keep in ("smallest", "largest"):
        got = exact.exact_groups(table(odd_rows), keep).drop("row").collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_groups(rows, keep == "largest")
        kept = [r for r in got if r.kept]
        assert len(kept) == len({t or "" for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_spread_text_gives_the_same_groups(table):
    rows = [(i, "the same text" if i % 3 else f"other {i}", None) for i in range(300)] + [(298, "the same text", None)]
    got = exact.exact_groups(table(rows), "largest", hot_rows=10).drop("row").collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute_groups([(i, t) for i, t, _ in rows], True)
    assert sum(r.kept for r in got) == 101


def test_copies_are_dropped_with_all_columns_kept(table, odd_rows):
    docs = table(odd_rows)
    left = exact.drop_exact_copies(docs, "largest")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 6, 7, 8]
    assert exact.drop_exact_copies(table([])).count() == 0


def test_normalised_groups(table):
    got = exact.exact_groups(table([(1, "A  b", None), (2, " a b ", None), (3, "ab", None)]), normalise="blanks").collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(1, 1), (2, 1), (3, 3)]


def brute_lines(rows, unit, min_words):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        units = lines.units_of(t or "", unit)
        norms = [" ".join(u.lower().split()) for u in units]
        left = []
        for k, u in enumerate(units):
            around = (*[norms[k - 1] if k else ""], norms[k], *[norms[k + 1] if k + 1 < len(norms) else ""])
            key = norms[k] if len(norms[k].split()) >= min_words else around
            if key not in seen:
                left.append(u)
            seen.add(key)
        out[i] = ("".join(left), len(units), len(units) - len(left))
    return out


def test_lines_equal_brute_force(table):
    rows = [(3, "A b c d e.\nshort.\nA b c d e.\nf g h i j k", None), (1, "f g h  i j k\n\na b C d e.", None), (2, None, None), (4, "", None), (5, "x. short. F g h i j k", None), (None, "q r s t u v", None),
            (9, "q r s t u v. And then the end of it all.", None)]
    for unit in ("line", "paragraph", "sentence"):
        got = {r.doc_id: r for r in lines.remove_repeats(table(rows), unit).collect()}
        want = brute_lines([(i, t) for i, t, _ in rows], unit, 5)
        assert {i: (r.text, r.n_units, r.n_removed) for i, r in got.items()} == want
        for i, t, _ in rows:
            r, text = got[i], t or ""
            cut, at = [], 0
            for s in r.removed:
                cut.append(text[at:s.start])
                at = s.end
            assert "".join([*cut, text[at:]]) == r.text and r.removed_chars == len(text) - len(r.text)


def test_lines_odd_rows(table, odd_rows):
    got = lines.remove_repeats(table(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert [r.text for r in got if r.doc_id in (5, 6)] == ["", "", ""] and [r.text for r in got if r.doc_id is None] == ["one two three four five six seven."]
    assert lines.remove_repeats(table([])).count() == 0


def test_short_units_go_with_their_surroundings(table):
    passage = "The first of all these sentences. So it is. No! Yes. And the last of all these sentences. "
    rows = [(1, "Before it stands another long sentence. " + passage + "No! ", "a"), (2, "Something else is said here first. " + passage + "Yes. So it is. ", "b"), (3, "No! ", "a"), (4, "Yes. ", "a"), (5, "Yes. ", "a")]
    got = {r.doc_id: r.text for r in lines.remove_repeats(table(rows)).collect()}
    assert got[2] == "Something else is said here first. Yes. So it is. "  # the passage as a whole, nothing else
    assert got[1] == rows[0][1] and (got[3], got[4], got[5]) == ("No! ", "Yes. ", "")


def test_passages_are_removed_with_their_short_sentences(table):
    import random

    rng = random.Random(6)

    def sentence(tag, n):
        return " ".join(f"{tag}{rng.randrange(10**6)}" for _ in range(n)) + ". "

    passages = ["".join(sentence(f"p{k}x", rng.choice((2, 3, 8, 12))) for _ in range(12)) for k in range(20)]
    rows, total = [], 0
    for i in range(200):
        own = [sentence(f"d{i}x", rng.choice((2, 9, 15))) for _ in range(6)]
        rows.append((i, "".join(own[:3]) + passages[i % 20] + "".join(own[3:]), "a"))
        total += len(passages[i % 20]) if i >= 20 else 0
    gone = 0
    for r in lines.remove_repeats(table(rows)).collect():
        gone += r.removed_chars
        if r.doc_id < 20:
            assert r.removed_chars == 0
    assert 0.95 * total < gone <= total  # only short sentences at the edges stay


def test_passages_inside_long_units_are_removed(table):
    import random

    rng = random.Random(8)

    def words(tag, n):
        return [f"{tag}{rng.randrange(10**6)}{rng.choice('abcdefghij')}" for _ in range(n)]

    passages = [words(f"p{k}", 70) for k in range(10)]
    rows, total = [], 0
    for i in range(100):
        rows.append((i, " ".join(words(f"d{i}", rng.randrange(20, 90)) + passages[i % 10] + words(f"e{i}", rng.randrange(20, 90))), "a"))  # no sentence ends at all
        total += len(" ".join(passages[i % 10])) if i >= 10 else 0
    gone = 0
    for r, (_, text, _) in zip(sorted(lines.remove_repeats(table(rows)).collect(), key=lambda r: r.doc_id), rows):
        gone += r.removed_chars
        own = [w for w in text.split() if w[0] in "de"]
        assert [w for w in r.text.split() if w[0] in "de"] == own  # nothing of the document itself
    assert 0.9 * total < gone <= total
