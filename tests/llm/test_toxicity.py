import random
import zlib

from llm_cases import edge_docs, empty_docs

from leakscan.llm import toxicity as T

TERMS = ["idiot", "scum", "pathetic", "worthless", "trash", "réeuxelle", "id"]


def distance(a, b):
    """Edits, a swap of two neighbours being one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            swap = rows[-2][j - 1] + 1 if i and j and x == b[j - 1] and a[i - 1] == y else 99
            new.append(min(rows[-1][j] + (x != y), rows[-1][j + 1] + 1, new[j] + 1, swap))
        rows.append(new)
    return rows[-1][-1]


def test_automaton_against_distances():
    rnd = random.Random(2)
    words = list(TERMS) + ["", "x", "idiots", "idot", "iidiott", "pathtic", "wrthles", "漢字", "z" * 500]
    for _ in range(4000):
        w = list(rnd.choice(TERMS))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randint(0, len(w))
            op = rnd.randint(0, 3)
            if op == 3:
                w[k:k + 2] = w[k:k + 2][::-1]
                continue
            w = w[:k] + ([rnd.choice("abcdeiotxé")] if op else []) + w[k + (op != 1):]
        words.append("".join(w))
    a = T.Automaton(TERMS)
    term, cost = a.match(words)
    for w, t, c in zip(words, term.tolist(), cost.tolist()):
        fit = [(distance(w, x)) for x in TERMS if distance(w, x) <= T.edits(x)]
        assert (t >= 0) == bool(fit)
        if fit:
            assert c == min(fit) == distance(w, TERMS[t])


def test_context():
    s = T.Scorer(["idiot", "stupid"], [3.0, 2.0])
    f = s.features(["you idiot you stupid fool", 'the man wrote "idiot" there', "he said idiot", "fine words", None, "", "an idoit and an idiott"])
    hits, quoted, near = f[:, 0], f[:, 3], f[:, 2]
    assert hits[0] > 0 and f[0, 5] > 0 and quoted[0] == 0
    assert hits[1] == hits[2] == 0 and quoted[1] > 0 and quoted[2] > 0
    assert not f[3:6].any() and hits[6] == 0 and near[6] > 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = T.score(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(rows[d], t) for d, t in truth.items() if rows[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in rows.items())
    toxic = [r.predicted for r, t in held if t == 1]
    clean = [r.predicted for r, t in held if t == 0]
    assert sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.02 * len(clean)


def test_edges(spark):
    labels = spark.createDataFrame([(4, None, None), (None, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = T.score(edge_docs(spark), labels).collect()
    assert len(out) == 15 and all(r.score == 0 and r.predicted == 0 for r in out)
    assert T.score(empty_docs(spark), labels).count() == 0


def test_strongest_terms_and_share_of_usable_labels(spark):
    # "topic" is in all toxic texts and some clean ones, "scumbag" in a few toxic ones only
    rows = [(k, 1, "topic word" + (" scumbag" if k < 8 else "")) for k in range(40)] + [(k, 0, "word" + (" topic" if k % 20 == 0 else "")) for k in range(40, 400)]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id bigint, text string")
    train = spark.createDataFrame([(k, y) for k, y, _ in rows], "doc_id bigint, toxic int")
    assert [w for w, _ in T.learn_lexicon(docs, train)] == ["scumbag", "topic"]
    assert [w for w, _ in T.learn_lexicon(docs, train, T.Toxicity(min_share=0.3))] == ["topic"]
    labels = spark.createDataFrame([(k, k % 2 if k < 100 else None) for k in range(5000)], "doc_id bigint, toxic int")
    usable = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(r.doc_id for r in T.training_labels(labels, T.Toxicity(max_labels=100)).collect()) == usable


def test_lexicon_has_no_cap(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}ord" for k in range(676)]
    docs = spark.createDataFrame([(k, " ".join(words) if k < 20 else "clean text") for k in range(200)], "doc_id bigint, text string")
    train = spark.createDataFrame([(k, int(k < 20)) for k in range(200)], "doc_id bigint, toxic int")
    assert sorted(w for w, _ in T.learn_lexicon(docs, train)) == sorted(words)


def test_disguised_spellings():
    s = T.Scorer(["idiot", "stupid", "scum", "moron"], [3.0, 2.0, 2.0, 2.0], frozenset(["scam", "moran"]))
    seen = s.features(["an id1ot", "so st*pid", "s-c-u-m", "s.t.u.p.i.d", "s t u p i d man", "sutpid", "idoit", "scim", "idiot@home", "stupid-idiot"])
    assert (seen[:, 1] > 0).all()
    clean = s.features(["a scam", "by moran", "mo1ran", "a b c d", "u-s-a", "x2y", "well-known", "3rd 5km", "scams", "e-mail me@host", "2 * 3"])
    assert not clean[[0, 1, 3, 4, 5, 6, 7, 9, 10]].any()
    assert s.look_up(["s-c-u-m", "stupid", "sutpid"])[1].tolist() == [0, 0, 1]


def test_misspelled_texts_are_caught(spark):
    rnd = random.Random(5)
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = T.training_labels(labels)
    terms = {t for t, _ in T.learn_lexicon(docs, train) if len(t) > 3}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in toxic]

    def spoil(w):
        if w.lower() not in terms:
            return w
        k = rnd.randint(1, len(w) - 2)
        return rnd.choice([w[:k] + "*" + w[k + 1:], w[:k] + "1" + w[k + 1:], w[:k] + w[k + 1] + w[k] + w[k + 2:], "-".join(w)])

    spoiled = spark.createDataFrame([(d, " ".join(spoil(w) for w in t.split())) for d, t in rows], "doc_id bigint, text string")
    learn = docs.join(spark.createDataFrame([(d,) for d, _ in rows], "doc_id bigint"), "doc_id", "left_anti").select("doc_id", "text")
    out = [r.predicted for r in T.score(learn.unionByName(spoiled), labels).collect() if r.doc_id in toxic]
    assert len(out) == len(rows) and sum(out) > 0.7 * len(out)


def test_common_words_are_innocent(spark):
    rows = [(k, 1, "scum here") for k in range(40)] + [(k, 0, "scam here" if k % 9 == 0 else "scub here" if k == 100 else "here") for k in range(40, 400)]
    docs = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id bigint, text string")
    words = T.word_counts(docs, spark.createDataFrame([(k, y) for k, y, _ in rows], "doc_id bigint, toxic int"))
    assert T.innocent(words, T.strongest(words)) == {"scam"}
