"""Filter expressions compiled to Columns over the canonical layout (site columns, samples array<struct>).

An expression has a site result and, where it reads sample fields, a mask with a truth value per sample:

    QUAL > 30 && TYPE = "snp"          N_PASS(GQ > 20 & DP > 10) >= 3
    FMT/DP[0] > 5 | GT = "het"         MAX(AD[:1]) > 4 && F_MISSING < 0.1

Site-level vectors compare by any pair of elements. `&` needs both sides in one sample, `&&` in any two samples; `|` selects
the samples that pass, `||` all samples of a site that passes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import variants as V

TOKENS = re.compile(r'\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<str>"[^"]*"(?:/i)?)|(?P<file>@[^\s)\]&|,]+)|(?P<given>\{(?:STR|INT|FLOAT)?\})|(?P<op>&&|\|\||==|!=|!~|<=|>=|[-+*/%<>=~&|()\[\],:])|(?P<name>(?:INFO/|FORMAT/|FMT/)?[A-Za-z_][A-Za-z0-9_.]*))')
LEVELS = [["|", "||"], ["&", "&&"], ["==", "=", "!=", "<", "<=", ">", ">=", "~", "!~"], ["+", "-"], ["*", "/", "%"]]
FUNCTIONS = {"MAX", "MIN", "AVG", "MEAN", "MEDIAN", "STDEV", "SUM", "ABS", "COUNT", "STRLEN", "PHRED", "BINOM", "FISHER", "N_PASS", "F_PASS"}
MOST_LISTED = 100_000  # lines of a file of names or values, which becomes part of the expression; longer ones are for a join
OF_GENOTYPES = {"N_MISSING", "F_MISSING", "AN", "AC", "AF", "MAC", "MAF"}
EXACT = 16777216  # up to here numbers compare in single precision
NUMBER = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
GT_CLASSES = {"mis", "hom", "het", "hap", "ref", "alt", "rr", "ra", "aa", "aA", "r", "a"}


@dataclass
class Value:
    """col at shape: site, site vector, sample (array) or sample vector (array of arrays). kind: number, text or truth."""

    col: Column
    per_sample: bool = False
    vector: bool = False
    kind: str = "number"
    tag: str = ""
    mask: Column | None = None
    literal: str | None = field(default=None)


class Compiler:
    def __init__(self, df: DataFrame):
        self.df = df
        self.site = {f.name: f.dataType for f in df.schema.fields}
        self.sample = {f.name: f.dataType for f in df.schema["samples"].dataType.elementType.fields} if "samples" in self.site else {}
        self.sampled = False  # whether anything of the samples was read

    # --- parsing
    def compile(self, text: str, *given) -> Value:
        """given: values for {}, {STR}, {INT} and {FLOAT}, in order."""
        self.tokens, at = [], 0
        self.given = list(given)
        text = text.rstrip()
        while at < len(text):
            m = TOKENS.match(text, at)
            if not m:
                raise ValueError(f"cannot read expression at: {text[at:]}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        out = self._level(0)
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]}")
        return out

    def _peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def _take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want and self.tokens[self.at][1] != want:
            raise ValueError(f"expected {want or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def _level(self, n: int) -> Value:
        if n == len(LEVELS):
            return self._atom()
        left = self._level(n + 1)
        while self._peek() in LEVELS[n]:
            op = self._take()[1]
            left = self._binary(op, left, self._level(n + 1))
        return left

    def _atom(self) -> Value:
        kind, text = self._take()
        if text == "-":
            v = self._atom()
            return self._mapped(v, lambda x: -x)
        if text == "(":
            v = self._level(0)
            self._take(")")
            return v
        if kind == "num":
            return Value(F.lit(float(text)), literal=text)
        if kind == "given":
            if not self.given:
                raise ValueError(f"no value for {text}")
            x = self.given.pop(0)
            as_text = text == "{STR}" or text == "{}" and isinstance(x, str)
            return Value(F.lit(str(x)), kind="text", literal=str(x)) if as_text else Value(F.lit(float(x)), literal=str(x))
        if kind == "file":
            return Value(F.lit(text), kind="text", literal=text, tag="@")
        if kind == "str":
            body = text[1:-3] if text.endswith("/i") else text[1:-1]
            return Value(F.lit(body), kind="text", literal=("(?i)" if text.endswith("/i") else "") + body)
        if kind == "name":
            if self._peek() == "(":
                return self._function(text)
            v = self._field(text)
            return self._subscript(v) if self._peek() == "[" else v
        raise ValueError(f"unexpected {text}")

    # --- fields
    def _field(self, name: str) -> Value:
        short = name.split("/")[-1]
        sample_only = name.startswith(("FORMAT/", "FMT/"))
        gts = self._genotypes() if short in OF_GENOTYPES and self.sample else None
        self.sampled |= short in self.sample or short in OF_GENOTYPES
        computed = {
            "TYPE": lambda: Value(F.transform(V.types(F.col("REF"), F.col("ALT")), lambda t: F.when(t.isin("ins", "del"), "indel").otherwise(t)), vector=True, kind="text", tag="TYPE"),
            "ILEN": lambda: Value(F.transform("ALT", lambda a: V.indel_length(F.col("REF"), a).cast("double")), vector=True),
            "N_ALT": lambda: Value(F.size("ALT").cast("double")), "N_SAMPLES": lambda: Value(F.size("samples").cast("double")),
            "N_MISSING": lambda: Value(self._missing(gts)), "F_MISSING": lambda: Value(self._missing(gts) / F.size("samples")),
            "AN": lambda: Value(self._an(gts)), "AC": lambda: Value(self._ac(gts), vector=True), "AF": lambda: Value(V.once(gts, lambda g: V.once(self._an(g), lambda n: F.transform(self._ac(g), lambda c: F.when(n > 0, c / n).otherwise(0.0)))), vector=True),
            "MAC": lambda: Value(self._mac(gts)), "MAF": lambda: Value(V.once(gts, lambda g: V.once(self._an(g), lambda n: F.when(n > 0, self._mac(g) / n).otherwise(0.0)))),
        }
        if not sample_only and short in self.site:
            kind = self.site[short].simpleString()
            vector = kind.startswith("array")
            element = kind[6:-1] if vector else kind
            k = "text" if element == "string" else "truth" if element == "boolean" else "number"
            cast = (lambda x: x.cast("double")) if k == "number" else (lambda x: x)
            return Value(F.transform(short, cast) if vector else cast(F.col(short)), vector=vector, kind=k, tag=short)
        if not sample_only and f"INFO_{short}" in self.site:
            return self._field(f"INFO_{short}")
        if not sample_only and not name.startswith("INFO/") and short in computed and short not in self.sample:
            return computed[short]()
        if not name.startswith("INFO/") and short in self.sample:
            kind = self.sample[short].simpleString()
            vector = kind.startswith("array")
            k = "text" if "string" in kind else "number"
            cast = (lambda x: x.cast("double")) if k == "number" else (lambda x: x)
            get = (lambda s: F.transform(s[short], cast)) if vector else (lambda s: cast(s[short]))
            return Value(F.transform("samples", get), per_sample=True, vector=vector, kind=k, tag=short)
        raise ValueError(f"no such field: {name}")

    @staticmethod
    def _genotypes() -> Column:
        return F.transform("samples", lambda s: V.alleles(s["GT"]))

    @staticmethod
    def _missing(gts: Column) -> Column:
        return F.size(F.filter(gts, lambda a: F.forall(a, lambda x: x.isNull()))).cast("double")

    @staticmethod
    def _an(gts: Column) -> Column:
        return F.size(F.filter(F.flatten(gts), lambda x: x.isNotNull())).cast("double")

    @staticmethod
    def _ac(gts: Column) -> Column:
        return V.once(F.flatten(gts), lambda a: F.transform(F.sequence(F.lit(1), F.size("ALT")), lambda i: F.size(F.filter(a, lambda x: x == i)).cast("double")))

    def _mac(self, gts: Column) -> Column:
        ref = lambda g: F.size(F.filter(F.flatten(g), lambda x: x == 0)).cast("double")
        least = lambda present: F.when(F.size(present) > 1, F.array_min(present)).otherwise(0.0)
        return V.once(gts, lambda g: V.once(F.filter(F.concat(F.array(ref(g)), self._ac(g)), lambda c: c > 0), least))

    def _subscript(self, v: Value) -> Value:
        self._take("[")
        parts, part = [], []
        while self._peek() != "]":
            text = self._take()[1]
            if text == ":":
                parts.append(part)
                part = []
            elif text != ",":
                part.append(text)
        self._take("]")
        parts.append(part)
        element = parts[-1]
        out = v
        if v.per_sample and (len(parts) > 1 or not v.vector):
            if parts[0] and parts[0][0].startswith("@"):
                names = self._listed(parts[0][0])
                pick = F.filter(F.sequence(F.lit(0), F.size("samples") - 1), lambda i: F.get("samples", i)["sample_id"].cast("string").isin(names))
                out = Value(F.transform(pick, lambda i: F.try_element_at(v.col, i + 1)), per_sample=True, vector=v.vector, kind=v.kind, tag=v.tag)
            elif parts[0] and parts[0] != ["*"]:
                pick = F.array(*(F.lit(int(i)) for i in parts[0]))
                out = Value(F.transform(pick, lambda i: F.try_element_at(v.col, i + 1)), per_sample=True, vector=v.vector, kind=v.kind, tag=v.tag)
            element = parts[1] if len(parts) > 1 else []
        if element and element != ["*"] and out.vector:
            if element == ["GT"]:
                gts = F.transform("samples", lambda s: V.alleles(s["GT"]))
                return Value(F.zip_with(out.col, gts, lambda x, g: F.transform(F.filter(F.array_distinct(g), lambda a: a.isNotNull()), lambda a: F.try_element_at(x, a + 1))), per_sample=True, vector=True, kind=out.kind, tag=out.tag)
            idx = self._indices(element)
            get = lambda x: F.try_element_at(x, F.lit(idx[0] + 1)) if len(idx) == 1 else F.transform(F.array(*map(F.lit, idx)), lambda i: F.try_element_at(x, i + 1))
            col = F.transform(out.col, get) if out.per_sample else get(out.col)
            return Value(col, per_sample=out.per_sample, vector=len(idx) > 1, kind=out.kind, tag=out.tag)
        return out

    @staticmethod
    def _indices(element: list[str]) -> list[int]:
        if "-" in element:
            return list(range(int(element[0]), int(element[2]) + 1))
        return [int(i) for i in element]

    # --- operators
    @staticmethod
    def _mapped(v: Value, f) -> Value:
        col = v.col
        if v.per_sample and v.vector:
            col = F.transform(col, lambda x: F.transform(x, f))
        elif v.per_sample or v.vector:
            col = F.transform(col, f)
        else:
            col = f(col)
        return Value(col, v.per_sample, v.vector, "number", v.tag)

    def _binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("&", "&&", "|", "||"):
            return self._logic(op, self._truth(a), self._truth(b))
        if op in "+-*/%":
            f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: F.try_divide(x, y), "%": lambda x, y: F.try_mod(x.cast("long"), y.cast("long")).cast("double")}[op]
            return self._arith(f, a, b)
        return self._compare("==" if op == "=" else op, a, b)

    @staticmethod
    def _arith(f, a: Value, b: Value) -> Value:
        if a.per_sample == b.per_sample and a.vector == b.vector:
            if a.per_sample and a.vector:
                col = F.zip_with(a.col, b.col, lambda x, y: F.zip_with(x, y, f))
            elif a.per_sample or a.vector:
                col = F.zip_with(a.col, b.col, f)
            else:
                col = f(a.col, b.col)
            return Value(col, a.per_sample, a.vector)
        if not b.per_sample and not b.vector:
            return Compiler._mapped(a, lambda x: f(x, b.col))
        if not a.per_sample and not a.vector:
            return Compiler._mapped(b, lambda y: f(a.col, y))
        raise ValueError("vectors of different shapes")

    @staticmethod
    def _test(op: str, text: bool):
        def number(x, y):
            big = (F.abs(x) > EXACT) | (F.abs(y) > EXACT)
            both = F.when(big, NUMBER[op](x, y)).otherwise(NUMBER[op](x.cast("float"), y.cast("float")))
            missing = {"==": x.isNull() & y.isNull(), "!=": x.isNull() != y.isNull()}.get(op, F.lit(False))
            return F.when(x.isNull() | y.isNull(), missing).otherwise(both)

        def words(x, y):
            missing = {"==": x.isNull() & y.isNull(), "!=": x.isNull() != y.isNull()}.get(op, F.lit(op == "!~"))
            hit = {"==": lambda: F.arrays_overlap(F.split(x, ","), F.split(y, ",")), "!=": lambda: ~F.arrays_overlap(F.split(x, ","), F.split(y, ",")), "~": lambda: F.rlike(x, y), "!~": lambda: ~F.rlike(x, y)}[op]()
            return F.when(x.isNull() | y.isNull(), missing).otherwise(hit)

        return words if text else number

    @staticmethod
    def _test_number(op: str, c: float):
        """Comparison with a number that the expression gives: the tree stays small."""

        def number(x, _):
            if abs(c) > EXACT:
                both = NUMBER[op](x, F.lit(c))
            else:
                both = F.when(F.abs(x) > EXACT, NUMBER[op](x, F.lit(c))).otherwise(NUMBER[op](x.cast("float"), F.lit(c).cast("float")))
            return F.coalesce(both, F.lit(op == "!="))

        return number

    @staticmethod
    def _bounds(op: str, x: Column, c: float) -> Column | None:
        """What a comparison in single precision implies for the column as it is stored, so that the scan can skip by it."""
        near = np.float32(c)
        low, high = min(c, float(np.nextafter(near, np.float32(-np.inf)))), max(c, float(np.nextafter(near, np.float32(np.inf))))
        return {">": lambda: x >= low, ">=": lambda: x >= low, "<": lambda: x <= high, "<=": lambda: x <= high, "==": lambda: (x >= low) & (x <= high)}.get(op, lambda: None)()

    def _compare(self, op: str, a: Value, b: Value) -> Value:
        if a.literal is not None and b.literal is None:
            a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        if b.tag == "@":
            names = self._listed(b.literal)
            one = lambda x: F.coalesce(x.cast("string").isin(names), F.lit(False)) == F.lit(op == "==")
            inside = (lambda x: F.exists(x, one)) if a.vector else one
            return self._masked(F.transform(a.col, inside)) if a.per_sample else Value(F.coalesce(inside(a.col), F.lit(False)), kind="truth")
        if b.literal == "." and b.kind == "text":
            return self._missing_test(op, a)
        if a.tag == "GT" and b.literal is not None and b.literal in GT_CLASSES and op in ("==", "!="):
            test = lambda g: V.in_class(g, b.literal) if op == "==" else ~V.in_class(g, b.literal)
            return self._masked(F.transform(a.col, test))
        if a.tag == "FILTER" and b.literal is not None:
            want = F.array(*map(F.lit, b.literal.split(";")))
            every = F.forall(want, lambda x: F.array_contains(a.col, x))
            site = {"==": every & (F.size(a.col) == F.size(want)), "!=": ~(every & (F.size(a.col) == F.size(want))), "~": every, "!~": ~every | (F.size(a.col) == 0)}[op]
            return Value(site, kind="truth")
        if a.tag == "TYPE" and b.literal is not None:
            is_type = lambda t: t == b.literal
            return Value({"==": F.forall(a.col, is_type), "!=": ~F.forall(a.col, is_type), "~": F.exists(a.col, is_type), "!~": ~F.exists(a.col, is_type)}[op], kind="truth")
        test = self._test(op, "text" in (a.kind, b.kind))
        if b.kind == "text" and b.literal is not None and op in ("~", "!~"):
            b = Value(F.lit(b.literal), kind="text", literal=b.literal)
        if a.kind == "truth":
            a = Value(a.col.cast("double"))
        given = a.kind == "number" and b.kind == "number" and b.literal is not None and not b.vector
        if given:
            test = self._test_number(op, float(b.literal))

        def any_pair(x, y):
            if a.vector and b.vector:
                return F.exists(x, lambda p: F.exists(y, lambda q: test(p, q)))
            return F.exists(x, lambda p: test(p, y)) if a.vector else F.exists(y, lambda q: test(x, q)) if b.vector else test(x, y)

        if not a.per_sample and not b.per_sample:
            bound = self._bounds(op, a.col, float(b.literal)) if given and not a.vector and a.tag else None
            hit = any_pair(a.col, b.col)
            return Value(hit if bound is None else bound & hit, kind="truth")
        if a.per_sample and b.per_sample:
            return self._masked(F.zip_with(a.col, b.col, any_pair))
        if a.per_sample:
            return self._masked(F.transform(a.col, lambda x: any_pair(x, b.col)))
        return self._masked(F.transform(b.col, lambda y: any_pair(a.col, y)))

    def _listed(self, file: str) -> list[str]:
        """Lines of a file that the expression names as @file."""
        lines = [r[0].strip() for r in self.df.sparkSession.read.text(file[1:]).limit(MOST_LISTED + 1).collect()]
        if len(lines) > MOST_LISTED:
            raise ValueError(f"{file} has more than {MOST_LISTED} lines: join with it instead")
        return [x for x in lines if x]

    def _missing_test(self, op: str, a: Value) -> Value:
        if a.tag == "FILTER":
            return Value((F.size(a.col) == 0) == F.lit(op == "=="), kind="truth")
        if a.tag == "GT":
            return self._masked(F.transform(a.col, lambda g: V.in_class(g, "mis") == F.lit(op == "==")))
        none = (lambda x: x.isNull() | F.forall(x, lambda y: y.isNull())) if a.vector else (lambda x: x.isNull())
        if a.per_sample:
            return self._masked(F.transform(a.col, lambda x: none(x) == F.lit(op == "==")))
        return Value(none(a.col) == F.lit(op == "=="), kind="truth")

    @staticmethod
    def _masked(mask: Column) -> Value:
        mask = F.transform(mask, lambda x: F.coalesce(x, F.lit(False)))
        return Value(F.exists(mask, lambda x: x), kind="truth", mask=mask)

    def _truth(self, v: Value) -> Value:
        return v if v.kind == "truth" else self._compare("!=", v, Value(F.lit(0.0), literal="0"))

    @staticmethod
    def _logic(op: str, a: Value, b: Value) -> Value:
        site = (a.col & b.col) if op[0] == "&" else (a.col | b.col)
        if a.mask is None and b.mask is None:
            return Value(site, kind="truth")
        wide = lambda v, w: v.mask if v.mask is not None else F.transform(w.mask, lambda _: v.col)
        x, y = wide(a, b), wide(b, a)
        if op == "&":
            return Compiler._masked(F.zip_with(x, y, lambda p, q: p & q))
        if op == "&&":
            return Value(site, kind="truth", mask=F.when(site, F.zip_with(x, y, lambda p, q: p | q)).otherwise(F.transform(x, lambda _: F.lit(False))))
        if op == "|":
            return Value(site, kind="truth", mask=F.zip_with(x, y, lambda p, q: p | q))
        return Value(site, kind="truth", mask=F.transform(x, lambda _: site))

    # --- functions
    def _function(self, name: str) -> Value:
        self._take("(")
        args = [self._level(0)]
        while self._peek() == ",":
            self._take(",")
            args.append(self._level(0))
        self._take(")")
        each = name.startswith(("SMPL_", "s")) and name.removeprefix("SMPL_").removeprefix("s") in FUNCTIONS
        base = name.removeprefix("SMPL_").removeprefix("s") if each else name
        if base not in FUNCTIONS:
            raise ValueError(f"no such function: {name}")
        v = args[0]
        if base in ("N_PASS", "F_PASS"):
            n = F.size(F.filter(v.mask, lambda x: x)).cast("double")
            return Value(n if base == "N_PASS" else n / F.size("samples"))
        if base == "COUNT" and v.mask is not None:
            return Value(F.size(F.filter(v.mask, lambda x: x)).cast("double"))
        if base in ("ABS", "STRLEN", "PHRED"):
            return self._mapped(v, {"ABS": F.abs, "STRLEN": lambda x: F.length(x).cast("double"), "PHRED": lambda x: F.when(x > 0, -10 * F.log10(x))}[base])
        if base == "BINOM":
            if len(args) == 2:
                return self._arith(V.binomial_test, v, args[1])
            pair = lambda x: V.binomial_test(x[0], x[1])
            return Value(F.transform(v.col, pair), per_sample=True) if v.per_sample else Value(pair(v.col))
        if base == "FISHER":
            four = (lambda x: V.fisher(F.get(x, F.lit(0)), F.get(x, F.lit(1)), F.get(x, F.lit(2)), F.get(x, F.lit(3)))) if len(args) == 1 else (lambda x, y: V.fisher(F.get(x, F.lit(0)), F.get(y, F.lit(0)), F.get(x, F.lit(1)), F.get(y, F.lit(1))))
            if len(args) == 1:
                return Value(F.transform(v.col, four), per_sample=True) if v.per_sample else Value(four(v.col))
            return Value(F.zip_with(v.col, args[1].col, four), per_sample=True) if v.per_sample else Value(four(v.col, args[1].col))
        f = getattr(self, "_" + base.lower())
        if each:
            return Value(F.transform(v.col, f) if v.vector else v.col, per_sample=True)
        flat = F.flatten(v.col) if v.per_sample and v.vector else v.col if v.per_sample or v.vector else F.array(v.col)
        return Value(f(flat))

    @staticmethod
    def _present(x: Column) -> Column:
        return F.filter(x, lambda e: e.isNotNull())

    def _max(self, x: Column) -> Column:
        return F.array_max(x)

    def _min(self, x: Column) -> Column:
        return F.array_min(x)

    def _sum(self, x: Column) -> Column:
        return V.once(self._present(x), lambda p: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, b: a + b)))

    def _avg(self, x: Column) -> Column:
        return V.once(self._present(x), lambda p: self._sum(p) / F.size(p))

    _mean = _avg

    def _median(self, x: Column) -> Column:
        middle = lambda p, n: (F.element_at(p, F.floor((n + 1) / 2).cast("int")) + F.element_at(p, F.floor(n / 2 + 1).cast("int"))) / 2
        return V.once(F.array_sort(self._present(x)), lambda p: F.when(F.size(p) > 0, middle(p, F.size(p))))

    def _stdev(self, x: Column) -> Column:
        squares = lambda p, mean: F.aggregate(p, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean))
        return V.once(self._present(x), lambda p: V.once(self._avg(p), lambda mean: F.when(F.size(p) > 0, F.sqrt(squares(p, mean) / F.size(p)))))

    def _count(self, x: Column) -> Column:
        return F.size(self._present(x)).cast("double")


def include(df: DataFrame, expression: str, *given) -> DataFrame:
    """Sites that pass."""
    return df.where(Compiler(df).compile(expression, *given).col)


def exclude(df: DataFrame, expression: str, *given) -> DataFrame:
    """Sites that do not pass; an unknown result counts as not passing."""
    return df.where(~F.coalesce(Compiler(df).compile(expression, *given).col, F.lit(False)))


def with_result(df: DataFrame, expression: str, site: str = "pass_site", samples: str = "pass_samples", given: tuple = ()) -> DataFrame:
    """Adds the site result and the mask, or null where the expression reads no sample field. given: values of {}."""
    c = Compiler(df)
    v = c.compile(expression, *given)
    mask = F.lit(None).cast("array<boolean>") if v.mask is None else v.mask
    if not c.sampled:
        return df.withColumn(site, F.coalesce(v.col, F.lit(False))).withColumn(samples, mask)
    # a generator of one row: a filter on the result is not pushed below it, which would have the work on samples done twice, and
    # in the few tasks that read the table
    return df.select("*", F.inline(F.array(F.struct(F.coalesce(v.col, F.lit(False)).alias(site), mask.alias(samples)))))


def soft_filter(df: DataFrame, expression: str, name: str, replace: bool = False, given: tuple = ()) -> DataFrame:
    """FILTER gets name at sites that pass the expression, PASS elsewhere if it was empty. FILTER is an array."""
    hit = F.coalesce(Compiler(df).compile(expression, *given).col, F.lit(False))
    kept = F.array_except("FILTER", F.array(F.lit("PASS")))
    marked = F.array(F.lit(name)) if replace else F.array_union(kept, F.array(F.lit(name)))
    return df.withColumn("FILTER", F.when(hit, marked).when(F.size(kept) == 0, F.array(F.lit("PASS"))).otherwise(kept))


def with_value(df: DataFrame, name: str, expression: str, *given) -> DataFrame:
    """Adds the value of an expression, as a number, a text or a truth of the site."""
    return df.withColumn(name, Compiler(df).compile(expression, *given).col)
