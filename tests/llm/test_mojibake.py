import random

import pytest

from timberline.llm import mojibake as M

CLEAN = [
    "Après la mise à jour, l’étape {} a échoué à cause du dépôt {}.",
    "Die Größe von {} überschreibt möglicherweise den Schlüssel für {}.",
    "El tamaño de {} superó el límite pequeño, ¿quién cambió la opción {}?",
    "It’s unclear why “{}” keeps asking for {} — the lock file says otherwise…",
    "Сборка {} остановилась, потому что {} не ответил вовремя и без ошибок.",
    "构建 {} 在第 15 步失败，因为 {} 没有响应。",
    "Não há razão para {} ignorar a configuração de {}.",
]
PLAIN = ["Nothing in {} had changed, yet {} was rebuilt.", "[INFO] {} took 15s", "├── {}/x.rs\n│   └── {} ✓ 🚀"]


def name(r):
    return "".join(r.choice("ba ko ne ru mi ta lo ze".split()) for _ in range(3))


def docs(n, seed):
    r = random.Random(seed)
    return ["\n".join(r.choice(CLEAN + PLAIN).replace("{}", "%s").replace("%s", "{}").format(name(r), name(r)) for _ in range(6)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    train = docs(400, 1)
    r = random.Random(2)
    for i in range(0, 400, 25):  # the sample holds garbled records too
        c = r.choice(M.CHAINS[:10])
        train[i] = M.garble(train[i], c) or train[i]
    return M.fit(train)


def test_held_out(model):
    held = docs(300, 3)
    wrong = [d for d in held if model.repair(d)[0]]
    assert not wrong, wrong[:2]
    for chain in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("koi8-r", "cp1251"), ("gbk", "cp1252")):
        seen = good = back = 0
        for d in held:
            text = "\n".join(x for x in d.split("\n") if M.writes(chain[0], "".join(c for c in x if c > "\x7f") + x) and not x.isascii() and not (chain[0] != "utf-8" and any(c in x for c in "├│└✓🚀")))
            g = M.garble(text, chain) if text else None
            if not g or "?" in g.replace("?", "", text.count("?")):
                continue
            seen += 1
            c, t = model.repair(g)
            good += bool(c)
            back += t == text
        assert seen > 20 and good >= 0.97 * seen, (chain, seen, good)
        assert back >= 0.8 * seen, (chain, seen, back)


def test_part_of_a_text(model):
    t = "Nothing had changed.\nWeâ€™ve muted kone until rumi ships.\nEl tamaño de kone superó el límite."
    chains, fixed = model.repair(t)
    assert chains and fixed == t.replace("â€™", "’")


def test_lost_letters_are_reported_not_restored(model):
    chains, t = model.repair("It�s unclear why the lock file says �no�.")
    assert chains and "�" in t


def test_edges(model):
    for t in (None, "", " \n\t", "plain ascii", "ATENÇÃO: A PARTIÇÃO NÃO É ESTÁVEL.", "caf%C3%A9 '\\u00e9'", "x" * 50_000):
        assert model.repair(t)[0] == []


def test_inverse_is_strict():
    assert M.invert("Ã©", ("utf-8", "cp1252")) == "é"
    assert M.invert("é", ("utf-8", "cp1252")) is None
    assert M.invert(M.garble("“quoted” …", ("utf-8", "cp1252")), ("utf-8", "cp1252")) == "“quoted” …"


def test_frame(spark):
    rows = [(i, t) for i, t in enumerate(docs(150, 4))] + [(900, "Lâ€™Ã©tape kone a Ã©chouÃ© Ã\xa0 cause du dÃ©pÃ´t rumi."), (901, None), (902, ""), (900, "Lâ€™Ã©tape kone a Ã©chouÃ© Ã\xa0 cause du dÃ©pÃ´t rumi.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = M.repaired(df, M.train(df)).collect()
    assert [r["doc_id"] for r in got] == [900]
    assert got[0]["restored"].startswith("L’étape kone a échoué à cause")
    assert M.repaired(df.limit(0), M.fit([])).collect() == []
