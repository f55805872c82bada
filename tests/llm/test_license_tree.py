"""The licence scan on a generated tree against a plain version of its definition."""

import random
from collections import Counter
from math import log, sqrt

from sluice.llm import licenses


def plain_scan(files: list[tuple], threshold: float = 0.7) -> dict:
    """(license, inherited from, licence file) of each file, unit by unit and directory by directory."""
    templates = licenses.all_templates()
    texts = [(i, p or "", t or "") for i, p, t in files]
    df = Counter(t for _, _, text in texts for t in set(licenses.terms(text.lower())))
    vocabulary = {t for text in templates.values() for t in licenses.terms(text.lower())}
    idf = lambda t: log((len(texts) + 1) / ((df[t] if t in vocabulary else 0) + 1)) + 1

    def vector(words: list[str]) -> dict:
        return {t: (1 + log(n)) * idf(t) for t, n in Counter(words).items()}

    size = lambda v: sqrt(sum(x * x for x in v.values()))
    vectors = {n: vector(licenses.terms(t.lower())) for n, t in templates.items()}
    sizes = {n: size(v) for n, v in vectors.items()}

    def cosines(words: list[str], names) -> list[tuple]:
        a = vector(words)
        return [(sum(x * vectors[n][t] for t, x in a.items() if t in vectors[n]) / (size(a) * sizes[n]) if a else 0.0, n) for n in names]

    short = {n for n, t in templates.items() if len(licenses.terms(t.lower())) <= licenses.LONG}
    declared, whole = {}, {}
    for i, path, text in texts:
        lines = [w for line in text.lower().split("\n") if (w := licenses.terms(line))]
        full = [(c, n) for c, n in cosines(licenses.terms(text.lower()), vectors) if c >= threshold]
        heads = [m for a in range(len(lines)) for k in range(1, min(licenses.JOINED, len(lines) - a) + 1) for m in cosines(sum(lines[a : a + k], []), short)]
        got = [m for m in full if m[1].endswith("#text")] or full + [m for m in heads if m[0] >= threshold]
        whole[i] = bool(full)
        declared[i] = min((-round(c, 9), n.split("#")[0]) for c, n in got) if got else None
    folder = lambda p: p.rpartition("/")[0]
    covered: dict[str, tuple] = {}
    is_file = {}
    for i, path, _ in texts:
        named = path.rpartition("/")[2].upper().startswith(("LICENSE", "COPYING"))
        is_file[i] = bool(declared[i]) and (whole[i] or named)
        if is_file[i]:
            covered[folder(path)] = min(covered.get(folder(path), declared[i]), declared[i])
    out = {}
    for i, path, _ in texts:
        at, origin = folder(path), None
        while declared[i] is None:
            if at in covered:
                origin = at
                break
            if not at:
                break
            at = folder(at)
        out[i] = (declared[i][1] if declared[i] else covered[origin][1] if origin is not None else None, origin, is_file[i])
    return out


def tree(seed: int, n: int) -> list[tuple]:
    r, templates = random.Random(seed), licenses.all_templates()
    code = lambda: "\n".join(f"{r.choice('abcdef')}{r.randrange(90)} = call({r.randrange(9)})" for _ in range(r.randrange(1, 9)))
    folders = [""] + ["/".join(r.choice("xyz") for _ in range(r.randrange(1, 6))) for _ in range(25)]
    files: list[tuple] = [(0, None, None), (1, "", ""), (2, "x//y/odd", code()), (3, "/LICENSE", templates["MIT#text"]), (4, "q/long.c", "call of x9 " * 30_000)]
    for i in range(5, n):
        at = r.choice(folders) if r.random() < 0.7 else "hot/dir"
        prefix = at + "/" if at else ""
        kind = r.random()
        name = r.choice(sorted(templates))
        if kind < 0.08:
            files.append((i, prefix + r.choice(["LICENSE", "LICENSE.txt", "COPYING"]), templates[name]))
        elif kind < 0.16:
            files.append((i, f"{prefix}f{i}.py", "# " + templates[name][:400] + "\n" + code()))
        else:
            files.append((i, f"{prefix}f{i}.py", code()))
    return files


def test_a_generated_tree(spark):
    for seed, n in ((1, 110), (2, 70)):
        files = tree(seed, n)
        df = spark.createDataFrame([(*f, "own") for f in files], "doc_id long, path string, text string, license string")
        got = {r.doc_id: (r.license, r.inherited_from, r.is_license_file) for r in licenses.scan_licenses(df).collect()}
        want = plain_scan(files)
        assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
        assert sum(origin is not None for _, origin, _ in want.values()) > 10
