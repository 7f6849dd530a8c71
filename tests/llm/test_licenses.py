import textwrap

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from undula.llm import licenses


def brute(text, templates, least):
    import re

    norm = re.sub(r"[^\w\n]+|_+", " ", (text or "").lower())
    units = {" ".join(u.split()) for u in [*norm.split("\n"), *re.split(r"\n\s*\n", norm), norm]}
    best, names = None, set()
    for unit in units:
        own = set(zip(unit.split(), unit.split()[1:], strict=False))
        for name, texts in templates.items():
            for t in texts:
                other = {tuple(b.split()) for b in licenses.bigrams_of(t)}
                if own and other and 2 * len(own & other) / (len(own) + len(other)) >= least - 1e-9:
                    names.add(name)
                    rank = (-len(own & other), len(own) + len(other), name, unit)
                    best = min(best, rank) if best else rank
    return (best[2], -2 * best[0] / best[1], best[3], len(names)) if best else (None, None, None, 0)


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_against_brute_force(corpus, rng, least):
    every = [t for ts in licenses.TEMPLATES.values() for t in ts]
    rows = list(enumerate(ODD))
    for i in range(100, 300):
        words = rng.choice([t for t in every if len(t) < rng.choice([100, 2000])]).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["the", "MIT", "license", "foo", "3", ""])
        lines = [" ".join(rng.choice(["under", "the", "of", "License", "mit"]) for _ in range(rng.randint(0, 9))) for _ in range(3)]
        lines.insert(rng.randint(0, 3), " ".join(words).replace(" ", rng.choice([" ", "  ", "\n", " - "]), 1))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: (r.license_id, r.dice, r.unit, r.n_licenses) for r in licenses.scan(corpus(rows), least=least).collect()}
    for i, t in rows:
        want = brute(t, licenses.TEMPLATES, least)
        assert got[i][0] == want[0] and got[i][2:] == want[2:] and got[i][1] == (pytest.approx(want[1]) if want[1] else None), (i, t)


REAL = {
    "MIT": licenses.fixed.TEXTS["MIT"].split("\n\n")[2],
    "Apache-2.0": licenses.fixed.HEADERS["Apache-2.0"][0],
    "GPL-3.0": licenses.fixed.HEADERS["GPL-3.0"][0],
    "BSD-2-Clause OR BSD-3-Clause": licenses.fixed.TEXTS["BSD-3-Clause"].split("\n\n")[2],
    "BSD-3-Clause": licenses.fixed.TEXTS["BSD-3-Clause"].replace("OWNER", "The Regents of somewhere").replace("the copyright holder nor", "the University nor"),
    "ISC": licenses.fixed.TEXTS["ISC"],
    "AGPL-3.0": licenses.fixed.HEADERS["AGPL-3.0"][0].replace("This program", "Example"),
    "MPL-2.0": licenses.fixed.HEADERS["MPL-2.0"][0],
    "Unlicense": licenses.fixed.TEXTS["Unlicense"],
}


def test_real_texts_are_found(corpus):
    """As a paragraph, wrapped and commented, and amid other text; licences that resemble each other are told apart."""
    rows, want = [], {}
    for name, text in REAL.items():
        flat = [" ".join(p.split()) for p in text.strip().split("\n\n")]
        wrapped = "\n".join(" * " + line for p in flat for line in [*textwrap.wrap(p, 70), ""])
        for form in ("\n\n".join(flat), wrapped, "Some words come before it.\n\n" + "\n\n".join(flat) + "\n\nint main() { return 0; }"):
            want[len(rows)] = name
            rows.append((len(rows), form))
    for notice, name in (("Licensed under the MIT License.", "MIT"), ("Licensed under the GNU General Public License v3.0.", "GPL-3.0"), ("released under the Apache license, version 2.0", "Apache-2.0"), ("This work is licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Released under the MIT License. " * 60, "MIT")):
        want[len(rows)] = name
        rows.append((len(rows), notice))
    clean = ["The licence of a driver is granted by the state.", "This program is distributed in the hope of an audience.", "Permission to enter was granted, free of charge, to any person."]
    rows += [(len(rows) + i, t) for i, t in enumerate(clean)]
    got = {r.doc_id: (r.license_id, r.dice, r.n_licenses) for r in licenses.scan(corpus(rows)).collect()}
    assert {i: got[i][0] for i in want} == want and [got[i][2] for i in list(got) if i not in want] == [0] * len(clean)


def test_odd_rows_and_templates(spark, corpus):
    docs = corpus([(None, "Released under the MIT License.", 1), (1, "Released under the MIT License.", 2), (1, "Released under the MIT License.", 3)], "doc_id long, text string, unit int")
    docs = docs.withColumns({c: F.lit(1) for c in ("norm", "flat", "matches", "best", "license_id")})
    assert [r.license_id for r in licenses.scan(docs).collect()] == ["MIT"] * 3
    assert {r.n_licenses for r in licenses.scan(docs, {"one": ["word"]}).collect()} == {0}
    assert [r.license_id for r in licenses.scan(docs, {"own": ["released under the mit license"]}, 1.0).collect()] == ["own"] * 3
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="least"):
        licenses.scan(docs, least=0)
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan
