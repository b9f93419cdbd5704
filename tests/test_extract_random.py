"""Random nested programs whose functions are known by construction."""

import random

import pytest

from quarry.operators import extract as ex

OPENERS = ["if x > 0", "for i in 1:n", "while ok", "let a = 1", "begin", "try", "@inbounds for j in js"]
STATEMENTS = ["x = 1", "y = f(x)", "return x", "push!(out, i)", "if a; b; end", "s = \"if not code\""]
DOCS = ["# about {n}", "\"doc {n}\"", "@doc raw\"d{n}\"", "@inline", None, None, "TRIPLE"]


class Program:
    def __init__(self, rnd):
        self.rnd, self.lines, self.functions, self.counter = rnd, [], [], 0

    def emit(self, text):
        self.lines.append(text)
        return len(self.lines)               # 1-based line number

    def block(self, depth, budget):
        ind = "    " * depth
        for _ in range(self.rnd.randint(0, 4)):
            if budget <= 0:
                break
            r = self.rnd.random()
            if r < 0.25:
                budget = self.function(depth, budget - 1)
            elif r < 0.45:
                self.emit(ind + self.rnd.choice(OPENERS))
                budget = self.block(depth + 1, budget - 1)
                self.emit(ind + "end")
            elif r < 0.55:
                self.emit(ind + "# note")
            elif r < 0.62:
                self.emit(ind + "@constraint(m, x >= 0)")
            elif r < 0.65:
                self.emit(ind + "#=")
                self.emit(ind + "  if this were code")
                self.emit(ind + "=#")
            elif r < 0.70:
                self.emit("")
            else:
                self.emit(ind + self.rnd.choice(STATEMENTS))
        return budget

    def function(self, depth, budget):
        ind = "    " * depth
        self.counter += 1
        n = self.counter
        doc = self.rnd.choice(DOCS)
        if doc == "TRIPLE":
            self.emit(ind + '"""')
            self.emit(ind + f"    f{n}(a, b)")
            self.emit(ind + '"""')
        elif doc is not None:
            self.emit(ind + doc.format(n=n))
            if self.rnd.random() < 0.3:
                self.emit("")
        if self.rnd.random() < 0.2:       # parameter list over two lines
            hdr = self.emit(ind + f"function f{n}(a,")
            cont = ind + "            b)"
            self.emit(cont)
            header = f"function f{n}(a,\n{cont}"
            body_start = hdr + 1
        else:
            hdr = self.emit(ind + f"function f{n}(a, b)")
            header, body_start = f"function f{n}(a, b)", hdr
        rec = {"name": f"f{n}", "line": hdr, "level": depth, "header": header, "body_start": body_start}
        budget = self.block(depth + 1, budget)
        rec["end_line"] = self.emit(ind + "end")
        self.functions.append(rec)
        return budget


def expected(prog):
    lines = prog.lines
    out = {}
    for f in prog.functions:
        k_prev = next((k for k in range(f["line"] - 2, -1, -1) if lines[k].strip()), None)
        prev = lines[k_prev].strip() if k_prev is not None else ""
        opener = prev.startswith(("function", "if ", "for ", "while ", "let ", "begin", "try", "@inbounds for"))
        if prev == '"""':                 # closing line of a triple-quoted docstring
            k_open = next(k for k in range(k_prev - 1, -1, -1) if lines[k].strip() == '"""')
            doc = "\n".join(lines[k_open:k_prev + 1]).strip()
        elif prev == "=#":
            doc = ""
        elif opener or prev.startswith("end"):
            doc = ""
        elif prev.startswith("#") or prev.startswith('"'):
            doc = prev
        elif prev.startswith("@") and "@doc" in prev:
            doc = prev
        else:
            doc = ""
        body = lines[f["body_start"]:f["end_line"] - 1]
        ind = "    " * (f["level"] + 1)
        top = [b for b in body if b.startswith(ind) and not b.startswith(ind + " ")]
        out[f["name"]] = {
            "function_header": f["header"],
            "line": f["line"], "end_line": f["end_line"], "level": f["level"], "doc_string": doc,
            "function_body": "\n".join(body),
            "has_internal_comments": any(b.strip().startswith("#") and not b.strip().startswith("#=")
                                         for b in top),
            "has_constraints": any(b.strip().startswith("@constraint") for b in top),
        }
    return out


@pytest.fixture(scope="module")
def programs():
    rnd = random.Random(7)
    progs = []
    for i in range(150):
        p = Program(rnd)
        p.block(0, rnd.randint(3, 25))
        progs.append((f"p{i}.jl", p))
    return progs


def test_random_programs(spark, programs):
    files = spark.createDataFrame([(name, "\n".join(p.lines)) for name, p in programs],
                                  "path string, text string")
    got = {}
    for r in ex.extract_functions(files).collect():
        got.setdefault(r["path"], {})[r["function_header"].split("(")[0][len("function "):]] = {
            k: r[k] for k in ("line", "end_line", "level", "doc_string", "function_body",
                              "has_internal_comments", "has_constraints", "function_header")}
    total = 0
    for name, p in programs:
        want = expected(p)
        total += len(want)
        assert got.get(name, {}) == want, name
    assert total > 100


def test_random_programs_stripped(spark, programs):
    files = spark.createDataFrame([(name, "\n".join(p.lines)) for name, p in programs],
                                  "path string, text string")
    got = {(r["path"], r["line"]): r["function_body"]
           for r in ex.extract_functions(files, keep_comments=False, keep_constraints=False).collect()}
    n = 0
    for name, p in programs:
        for f in p.functions:
            body = p.lines[f["body_start"]:f["end_line"] - 1]
            ind = "    " * (f["level"] + 1)
            kept = [b for b in body
                    if not (b.startswith(ind) and not b.startswith(ind + " ")
                            and b.strip().startswith(("#", "@constraint"))
                            and not b.strip().startswith("#="))]
            assert got[(name, f["line"])] == "\n".join(kept)
            n += 1
    assert n > 100
