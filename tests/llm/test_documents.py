"""Near duplicates, repeated windows, rules, secrets, toxicity and the pipeline against brute force."""

import re

import pytest

from roadsift.llm import minhash, rules, secret_scan, substrings, toxicity
from roadsift.llm.components import components

from .cases import SCHEMA, components_of, documents, near, shingles, without_repeats, words_of


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


def texts():
    return {r[0]: r[1] for r in documents() if r[0] is not None}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(table, size, percent):
    got = minhash.near_duplicates(table, words=size, percent=percent).collect()
    want = near(texts(), size, percent)
    assert len(got) == len(documents())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(texts()[r["doc_id"]], size)), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_short_near_duplicates(spark, size, percent):
    """Pairs of 5 to 30 words that differ at their ends; no two pairs share a word, so only partners can be linked."""
    import random

    r = random.Random(9)
    rows, linked = {}, 0
    for k in range(1500):
        words = [f"p{k}w{j}" for j in range(r.randint(5, 30))]
        other = list(words)
        for _ in range(r.choice([1, 1, 1, 2])):
            other.insert(r.choice([0, len(other)]), f"p{k}x{len(other)}")
        rows[2 * k], rows[2 * k + 1] = " ".join(words), " ".join(other)
    want = {}
    for k in range(1500):
        want |= near({i: rows[i] for i in (2 * k, 2 * k + 1)}, size, percent)
        linked += want[2 * k + 1] == 2 * k
    got = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), words=size, percent=percent).collect()
    lost = [r["doc_id"] for r in got if r["component_id"] != want[r["doc_id"]]]
    assert linked > 700 and not lost, (len(lost), linked)


def test_rows_that_share_an_id_are_one_document(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "p q r s t u v w"), (0, "a b c d e f g h"), (9, "other words only here")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(0, 0), (1, 0), (2, 0), (9, 9)}


def test_a_large_group_of_unlike_copies(spark, monkeypatch):
    """Blocks smaller than the group, and links that only the comparison inside a bucket finds."""
    import random

    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SET_BLOCK", 8)
    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = {}
    for k in range(70):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"n{r.randrange(40)}"
        rows[k] = " ".join(w)
    got = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    want = near(rows, 3, 85)
    assert len(set(want.values())) > 1 and {r["doc_id"]: r["component_id"] for r in got} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 40), (40, 45), (7, 7), (60, 61), (61, 60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of({x for e in edges for x in e}, edges)
    assert got == want and components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("part", [1 << 21, 500])
def test_repeated_windows(table, monkeypatch, part):
    monkeypatch.setattr(substrings, "PART", part)
    got = substrings.remove_repeats(table).select("row.doc_id", "row.kept", "n_words", "n_removed", "kept").toDF("doc_id", "own", "n_words", "n_removed", "kept").collect()
    want = without_repeats(texts())
    assert len(got) == len(documents())
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            left, removed = want[r["doc_id"]]
            assert (r["n_words"], r["n_removed"], r["kept"]) == (len(left) + removed, removed, " ".join(left))


def test_hash_collisions_of_windows_are_told_apart(monkeypatch):
    """With a hash of one value everything collides, and the bytes decide."""
    import numpy as np
    import pyarrow as pa

    rows = {k: t for k, t in list(texts().items())[:40] if t and len(t) < 3000}
    strings = substrings.Strings(13, 4)
    strings.add(pa.record_batch({"id": pa.array(list(rows)), "content": pa.array([0] * len(rows)), "text": pa.array(list(rows.values()))}))
    blocks = [b for bucket, b in strings.rows(1) if bucket >= 0]
    honest = sorted(substrings.repeated_in(blocks, 13))
    monkeypatch.setattr(substrings, "window_hashes", lambda h, d, n: (np.zeros(len(h), np.uint64), _whole(d, n)))
    assert sorted(substrings.repeated_in(blocks, 13)) == honest and honest


def _whole(doc, size):
    import numpy as np

    out = np.zeros(len(doc), bool)
    out[:max(0, len(doc) - size + 1)] = doc[:max(0, len(doc) - size + 1)] == doc[size - 1:]
    return out


def measures(text):
    text = text or ""
    w = words_of(text)
    grams, again = [tuple(w[k:k + 3]) for k in range(len(w) - 2)], set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            again |= {k, k + 1, k + 2}
    lines = [line for line in text.split("\n") if words_of(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def norm(line):
    return " ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words_of(line))


def verdicts(rows, limit, percent):
    holders = {}
    for i, t, _, host, *_ in rows:
        for line in {norm(x) for x in (t or "").split("\n")} - {""}:
            holders.setdefault((host, line), set()).add(i)
    hot = {k: min((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) > limit}
    out = []
    for i, t, _, host, *_ in rows:
        gone = [line for line in (t or "").split("\n") if (host, norm(line)) in hot and hot[host, norm(line)] != i]
        m, lost = measures(t), sum(len(words_of(x)) for x in gone)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        out.append((i, *m, failed, lost, not failed and 100 * (m[0] - lost) >= percent * m[0]))
    return out


def line_rows():
    rows = [r for r in documents() if len(r[1] or "") < 8000]
    filler = [f"filler {k} " + " ".join(f"f{k}x{j}" for j in range(60)) for k in range(12)]
    return rows + [(100 + k, "Shared   LINE of the host\n" * (k % 2 + 1) + filler[k // 2], "en", "hot", None, None, None, None) for k in range(12)]


def test_quality_rules(spark):
    rows = line_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rules.quality_rules(table, max_docs=1, min_percent_left=30).collect()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(verdicts(rows, 1, 30), key=repr)
    applied = rules.apply_rules(table, max_docs=1).collect()
    kept = [v for v in verdicts(rows, 1, 30) if v[-1]]
    assert applied[0].__fields__ == table.columns
    assert sorted(((r["doc_id"], len(words_of(r["text"]))) for r in applied), key=repr) == sorted(((v[0], v[1] - v[7]) for v in kept), key=repr)
    assert any(v[7] for v in kept)


def filler(k):
    return " ".join(f"f{k}x{j}" for j in range(60))


def test_rules_count_documents_and_lower_only_letters_a_to_z(spark):
    """60 documents twice: not more than 100 documents.  101 documents whose line differs in an accented capital: two lines."""
    twice = [(k, f"a shared line of words\n{filler(k)}", "h", 1) for k in range(60)] * 2
    accents = [(1000 + k, ("É" if k % 2 else "é") + f"TAPE of words\n{filler(k)}", "g", 1) for k in range(101)]
    docs = spark.createDataFrame(twice + accents, "doc_id long, text string, source string, n_chars int")
    got = rules.quality_rules(docs).collect()
    assert len(got) == 221 and not any(r["n_removed_words"] for r in got)
    assert {r["n_removed_words"] for r in rules.quality_rules(docs, max_docs=50).collect()} == {0, 3, 5}


def test_columns_of_the_caller_keep_their_names_and_values(spark):
    """Every working name, used and not, in any case of letters."""
    names = ["_k1", "k1", "K2", "_removed", "removed", "_sha", "SHA", "_spans", "spans", "_text", "row", "there", "kept", "at", "line"]
    rows = [(k, f"{filler(k)} token=abcdef{k}12\nline that all have here", "s", *names) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names if c not in ("K2", "SHA")) + ", `K2` string, `SHA` string")
    plain = [r[:3] for r in rows]
    values = dict(zip([c for c in names if c not in ("K2", "SHA")] + ["K2", "SHA"], names))
    cleaned = rules.apply_rules(docs, max_docs=2).collect()
    assert cleaned[0].__fields__ == docs.columns and sum("that all" in r["text"] for r in cleaned) == 1
    redacted = secret_scan.redact(docs, secret_scan.Ledger(spark)).collect()
    assert all("[secret]" in r["text"] and "token" not in r["text"] for r in redacted)
    import corpus_pipeline as p

    cut = p.substring_dedup(spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in cut} == {x[:2] for x in plain}  # nothing repeats for 13 words
    for out in (cleaned, redacted, cut):
        assert len(out) == 4 and all(r[c] == v for r in out for c, v in values.items())


def test_a_ledger_that_is_written_twice(spark):
    """A repeated or concurrent scan adds the same findings again."""
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "clean"), (3, "token=abcdefgh")], "doc_id long, text string")
    ledger = secret_scan.Ledger(spark)
    first = {(r["doc_id"], len(r["spans"])) for r in secret_scan.scan(docs, ledger).collect()}
    ledger.add(ledger.read())
    assert ledger.rows().count() == 4 and ledger.read().count() == 2
    got = secret_scan.scan(docs, ledger).collect()
    assert len(got) == 3 and {(r["doc_id"], len(r["spans"])) for r in got} == first and ledger.rows().count() == 4
    assert secret_scan.redact(docs, ledger).count() == 3


@pytest.mark.parametrize("few", [0, 50_000])
def test_two_versions_of_a_corpus_and_of_the_rules(spark, monkeypatch, few):
    """Only new texts are read in the second version; new rules read every text of the corpus again, beside the old findings."""
    monkeypatch.setattr(secret_scan, "FEW", few)
    monkeypatch.setattr(secret_scan, "SHARE", 0)
    old = spark.createDataFrame([(k, f"text {k} secret: value{k}99") for k in range(6)], "doc_id long, text string")
    new = spark.createDataFrame([(k, f"text {k} secret: value{k}99" if k < 4 else f"changed {k}") for k in range(6)] + [(9, None)], "doc_id long, text string")
    ledger = secret_scan.Ledger(spark)
    assert {len(r["spans"]) for r in secret_scan.scan(old, ledger).collect()} == {1}
    second = {r["doc_id"]: len(r["spans"]) for r in secret_scan.scan(new, ledger).collect()}
    assert second == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 9: 0} and ledger.rows().count() == 6 + 3
    later = secret_scan.Ledger(spark, ledger.path, rules=2)
    assert later.read().count() == 0 and {r["doc_id"]: len(r["spans"]) for r in secret_scan.scan(new, later).collect()} == second
    assert ledger.rows().count() == 9 + 7 and ledger.read().count() == 9


def secrets_of(text):
    """The base rules as they are stated: leftmost matches first, then the least length."""
    found = []
    for k, (pattern, group, least) in enumerate([(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
                                                 (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [(["assign", "access", "hex"][k], a, b) for a, k, b in sorted(found)]


def test_secrets_and_the_ledger(spark, table):
    ledger = secret_scan.Ledger(spark)
    got = secret_scan.scan(table, ledger).collect()
    base = lambda spans: [tuple(s) for s in spans if s["kind"] in ("assign", "access", "hex")]
    assert sorted(((r["doc_id"], base(r["spans"])) for r in got), key=repr) == sorted(((r[0], secrets_of(r[1])) for r in documents()), key=repr)
    assert any(r["spans"] for r in got)
    n = ledger.rows().count()
    assert n == len({r[1] or "" for r in documents()})
    more = spark.createDataFrame([(500, "token = abcdefgh"), (501, documents()[30][1])], "doc_id long, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in secret_scan.scan(more, ledger).collect()} == {500: 1, 501: 0}
    assert ledger.rows().count() == n + 1  # the known text wasn't read again
    clean = secret_scan.redact(more, ledger).collect()
    assert {r["text"] for r in clean if r["doc_id"] == 500} == {"[secret]"}


@pytest.mark.parametrize("text,kinds", [("ghp_" + "Zq" * 18, ["github"]), ("AKIA" + "A" * 15, []), ("TOKEN:'abcde'", []), ("API_KEY=abcdef", ["assign"]), ("paſſword=abcdef", []),
                                        ("-----BEGIN RSA PRIVATE KEY-----\nAB\n-----END RSA PRIVATE KEY-----", ["pem"])])
def test_single_secrets(text, kinds):
    assert [s["kind"] for s in secret_scan.scan_text(text)] == kinds


def test_toxicity_learns_and_holds_out(spark):
    import random
    import zlib

    r = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        w, bad = [r.choice(vocab) for _ in range(40)], k % 4 == 0
        if bad:
            w[r.randrange(40)] = "awful" + r.choice(["", "ly", "ness"])
        rows.append((k, " ".join(w), "x"))
        labels.append((k, int(bad), 1))
    docs = spark.createDataFrame([*rows, (None, None, None), (2000, "", None)], "doc_id long, text string, score string")
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()
    assert len(got) == 902 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 900]
    assert sum(x["predicted"] == int(x["doc_id"] % 4 == 0) for x in held) >= 0.95 * len(held)
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in none.collect()} == {0.5}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == substrings.remove_repeats(empty).count() == rules.quality_rules(empty).count() == 0
    assert secret_scan.scan(empty, secret_scan.Ledger(spark)).count() == rules.apply_rules(empty).count() == 0
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_pipeline_stages(spark, table):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "secret_scan", "packing"]
    rows = [(*r[:5],) for r in line_rows() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").distinct()
    for name, stage in p.STAGES:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
        if name == "packing":
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in before.select("doc_id").collect()}
            break
        assert docs.columns == before.columns
        a, b = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (before, docs))
        if name == "quality_rules":
            assert set(b) == {v[0] for v in verdicts([r for r in {*rows}], 100, 30) if v[-1]}
        elif name == "near_dedup":
            assert set(b) == {i for i, c in near(a, 5, 80).items() if i == c}
        elif name == "substring_dedup":
            want = without_repeats(a)
            assert {i: words_of(t) for i, t in b.items()} == {i: left for i, (left, _) in want.items()}
        else:
            assert set(a) == set(b) and not any(secrets_of(t) for t in b.values())
