import random

import numpy as np
import pytest

from gridreach.llm import urls as u


def brute(pages, rules=u.RULES, threshold=u.THRESHOLD):
    import re

    judged, links = [], {}
    for page, url, html in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        h, p = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, ok) for r, ok in rules if (h == r[: r.index("/")] or h.endswith("." + r[: r.index("/")])) and p.startswith(r[r.index("/") :])]
        _, r, ok = max(fits) if fits else (0, None, None)
        judged.append((page, h, p, r, ok))
        for to in set(re.findall(u.LINK, html or "")):
            to = to.lower()
            if h and to != h:
                links[h, to] = links.get((h, to), 0) + 1
    hosts = {j[1] for j in judged if j[1]}
    count = {h: sum(j[1] == h for j in judged) for h in hosts}

    def walk(edges, seeds):
        total = {}
        for (a, _), n in edges.items():
            total[a] = total.get(a, 0) + n
        mass = dict(seeds)
        for _ in range(u.ROUNDS):
            new = dict(seeds)
            for (a, b), n in edges.items():
                if a in mass:
                    new[b] = new.get(b, 0) + u.DAMPING * n / total[a] * mass[a]
            mass = new
        return mass

    seed = lambda ok: {h: n for h in hosts if (n := sum(j[1] == h and j[4] is ok for j in judged))}
    trust, distrust = walk(links, seed(True)), walk({(b, a): n for (a, b), n in links.items()}, seed(False))
    bad = {h for h in hosts if distrust.get(h, 0) - trust.get(h, 0) >= threshold * count[h]}
    return [(p, h, q, r, "allow" if (ok if ok is not None else h not in bad) else "block") for p, h, q, r, ok in judged]


def test_rules_and_propagation_equal_brute_force(spark):
    rng = random.Random(0)
    hosts = [f"{s}{d}.{t}" for s in ("", "www.", "m.") for d in ("example", "other", "spam", "ham", "hub") for t in ("com", "net", "org")]
    pages = [
        (1, None, None), (2, "no scheme", "<a href=//x.org/>"), (3, "HTTP://WWW.Example.COM/en/a?b#c", ""), (4, "http://example.com", None), (5, "http://example.com?x=/en/", None),
        (6, "https://sub.example.com/en/1", "<a href='http://OTHER.net/x'>"), (7, "ftp://badexample.com/en/", None), (8, "a://b://net/es/", None), (None, "http://net/fr/", None), (9, "http://xnet/fr/", None), (9, "http://xnet/fr/", None),
    ]
    for i in range(400):
        h = rng.choice(hosts[:6] if i % 3 == 0 else hosts)
        link = "".join(f'<a class=x HREF="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}/q?x">' for _ in range(rng.randrange(4)))
        pages.append((100 + i, f"https://{h}/{rng.choice(['en', 'es', 'fr'])}/{i}", f"<p>{link}<a href=/local>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS allowed", "'z' AS host")
    got = sorted((tuple(r) for r in u.judge(df).collect()), key=str)
    want = sorted(brute(pages), key=str)
    assert got == want
    methods = [r for r in want if r[3] is None and r[1]]
    assert {r[4] for r in methods} == {"allow", "block"}
    assert u.judge(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = u.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def fixpoint(edges, seeds):
    """Solution of mass = seeds + DAMPING * (mass handed along edges)."""
    hosts = sorted({h for e in edges for h in e[:2]} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for a, b, n in edges:
        w[at[b], at[a]] += n / sum(m for x, _, m in edges if x == a)
    x = np.linalg.solve(np.eye(len(hosts)) - u.DAMPING * w, [float(seeds.get(h, 0)) for h in hosts])
    return {h: v for h, v in zip(hosts, x, strict=True) if v}


def test_propagation_reaches_the_fixpoint(spark):
    chain = [(f"c{i}", f"c{i + 1}", 1) for i in range(25)]
    cycle = [("r0", "r1", 2), ("r1", "r2", 1), ("r2", "r0", 3), ("r0", "c3", 1), ("d", "d1", 1)]
    seeds = {"c0": 1000, "r1": 7, "lone": 2}
    want = fixpoint(chain + cycle, seeds)
    ee = spark.createDataFrame(chain + cycle, "src string, dst string, n long")
    got = {r.host: r.mass for r in u.propagate(ee, spark.createDataFrame([(h, float(n)) for h, n in seeds.items()], "host string, mass double")).collect()}
    assert set(got) == set(want) and all(abs(got[h] - want[h]) <= u.TOLERANCE for h in want)
    with pytest.raises(RuntimeError):
        u.propagate(ee, spark.createDataFrame([("r0", 1.0)], "host string, mass double"), rounds=5)


def test_distrust_eleven_links_away(spark):
    pages = [(i, f"http://www.net/es/{i}", "") for i in range(1000)]
    pages += [(2000 + i, f"http://h{i}.org/", f"<a href='http://{f'h{i - 1}.org' if i else 'www.net'}/'>") for i in range(12)]
    got = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).where("page_id >= 2000").collect()}
    assert got == {2000 + i: "block" for i in range(12)}
