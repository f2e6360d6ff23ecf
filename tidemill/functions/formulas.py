"""Formulas of answers: read without recursion, valued as numbers, and compared as functions of their unknowns.

A formula becomes a list of steps in postfix order. Two formulas of sums, products, quotients and whole powers are equal if they
agree at random points modulo a prime of 61 bits, which is exact but for odds of about degree / 2^61 a point; those with roots, other
powers or functions are compared at random real points in doubles. Time is proportional to the formula's length, which has no bound.
Letters side by side are a product of unknowns; four or more of them are a word, which is one unknown. log and ln are the natural one.
"""

from __future__ import annotations

import cmath
import math
import random
import re
from fractions import Fraction
from functools import lru_cache

PRIME = 2305843009213693921  # 2^61 - 31; one more than a multiple of 4, so -1 has a root
IMAGINARY = next(r for r in (pow(g, (PRIME - 1) // 4, PRIME) for g in range(2, 99)) if r * r % PRIME == PRIME - 1)
POINTS, CLOSE = 4, 1e-9
MOST_BITS = 4096

FUNCTIONS = {
    "sqrt": cmath.sqrt, "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x), "cot": lambda x: 1 / cmath.tan(x), "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan,
    "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "abs": abs,
}
TOKEN = re.compile(r"(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<name>\\?(?:arcsin|arccos|arctan|sinh|cosh|tanh|sin|cos|tan|sec|csc|cot|sqrt|exp|ln|log|abs|pi)(?![a-z])|\\[a-zA-Z]+|[a-zA-Z]{4,}|[a-zA-Zα-ωΑ-Ω])(?P<sub>_(?:\w|\{\w+\}))?|(?P<op>\*\*|[-+*/^(){}\[\]|!])")
SPACING = re.compile(r"\\(?:left|right|displaystyle|mathrm|text|,|;|!|:|\s)|[\s$]|\\\s")
SIGNS = {"\\cdot": "*", "\\times": "*", "\\div": "/", "**": "^", "\\lvert": "|", "\\rvert": "|", "\u03c0": "pi", "\\pi": "pi", "\u2212": "-"}
PRIORITY = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 2, "^": 4}


class Unread(ValueError):
    """Not a formula."""


class Irrational(ValueError):
    """A root, a function or a power that is not a whole number: nothing to work out modulo a prime."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = SPACING.sub(" ", text.replace("\u2212", "-").replace("\u03c0", "\\pi ")).replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac")
    while at < len(text):
        if text[at] == " ":
            at += 1
            continue
        m = TOKEN.match(text, at)
        if not m:
            raise Unread(text[at])
        at = m.end()
        if m["number"]:
            out.append(("number", m["number"]))
        elif m["op"]:
            out.append(("op", SIGNS.get(m["op"], m["op"])))
        else:
            name = SIGNS.get(m["name"], m["name"])
            bare = name.lstrip("\\")
            if name in "*/|":
                out.append(("op", name))
            elif bare in ("frac", *FUNCTIONS):
                out.append(("call", bare))
            else:
                out.append(("symbol", bare + (m["sub"] or "").replace("{", "").replace("}", "")))
            if m["sub"] and out[-1][0] != "symbol":
                raise Unread(m["sub"])
    return out


def _infix(text: str) -> list[tuple[str, str]]:
    """Tokens with fractions, n-th roots and arguments in brackets, and products written out."""
    tokens, out, closing = _tokens(text)[::-1], [], []  # closing: what to write when the bracket that is open closes

    def put(kind: str, token: str) -> None:
        if out and (out[-1][0] in ("number", "symbol") or out[-1][1] in (")", "!")) and (kind != "op" or token == "("):
            out.append(("op", "*"))
        out.append((kind, token))

    def argument() -> None:
        """The next argument of a command, in brackets: what stands in braces, or one digit or sign."""
        if tokens and tokens[-1] == ("op", "{"):
            return
        kind, token = tokens.pop() if tokens else ("", "")
        if kind == "number" and len(token) > 1 and "." not in token:
            tokens.append((kind, token[1:]))
            token = token[0]
        if kind not in ("number", "symbol"):
            raise Unread("an argument")
        tokens.extend([("op", "}"), (kind, token), ("op", "{")])

    bars = 0
    while tokens:
        kind, token = tokens.pop()
        if kind == "call" and token == "frac":
            put("op", "(")
            argument()
            tokens.pop()
            out.append(("op", "("))
            closing.append("frac")
        elif kind == "call" and token == "sqrt" and tokens and tokens[-1] == ("op", "["):
            end = next((i for i in range(len(tokens) - 1, -1, -1) if tokens[i] == ("op", "]")), None)
            if end is None:
                raise Unread("[")
            power = tokens[end + 1 : -1]
            del tokens[end:]
            put("op", "(")
            argument()
            tokens.pop()
            out.append(("op", "("))
            closing.append(power[::-1])
        elif kind == "call":
            if token == "sqrt" and tokens and tokens[-1] != ("op", "("):
                argument()
            power = []
            if tokens and tokens[-1] == ("op", "^"):  # sin^2 x
                tokens.pop()
                argument()
                end = next(i for i in range(len(tokens) - 1, -1, -1) if tokens[i] == ("op", "}"))
                power = [("op", "^"), ("op", "("), *tokens[end + 1 : -1][::-1], ("op", ")")]
                del tokens[end:]
            put("call", token)
            if tokens and tokens[-1] in (("op", "("), ("op", "{")):
                tokens.pop()
                out.append(("op", "("))
                closing.append(("end", power))
            else:  # sin 2x: up to the next sign
                out.append(("op", "("))
                end = next((i for i in range(len(tokens) - 1, -1, -1) if tokens[i][0] == "op" and tokens[i][1] not in "^{!" or tokens[i][0] == "call"), -1)
                tokens[end + 1 : end + 1] = [("op", ")")]
                closing.append(("end", power))
        elif token == "|":
            opens = not out or out[-1][1] in ("(", "+", "-", "*", "/", "^") and out[-1][0] == "op"
            if opens:
                put("call", "abs")
                out.append(("op", "("))
                closing.append("bar")
                bars += 1
            elif bars and closing and closing[-1] == "bar":
                closing.pop()
                bars -= 1
                out.append(("op", ")"))
            else:
                raise Unread("|")
        elif token in ("(", "{", "["):
            put("op", "(")
            closing.append("")
        elif token in (")", "}", "]"):
            then = closing.pop() if closing else None
            if then is None or then == "bar":
                raise Unread(token)
            out.append(("op", ")"))
            if then == "frac":
                out.append(("op", "/"))
                argument()
                tokens.pop()
                out.append(("op", "("))
                closing.append("over")
            elif then == "over":
                out.append(("op", ")"))
            elif isinstance(then, tuple):
                out.extend(then[1])
            elif then:
                out.extend([("op", "^"), ("op", "("), ("number", "1"), ("op", "/"), ("op", "("), *then, ("op", ")"), ("op", ")"), ("op", ")")])
        else:
            put(kind, token)
    if closing:
        raise Unread("a bracket stays open")
    return out


@lru_cache(4096)
def read(text: str) -> tuple[tuple[str, str], ...] | None:
    """Steps in postfix order; None for what is not a formula."""
    try:
        steps, held, operand = [], [], False
        for kind, token in _infix(text):
            if kind in ("number", "symbol"):
                if operand:
                    raise Unread(token)
                steps.append((kind, token))
                operand = True
            elif kind == "call" or token == "(":
                held.append((kind, token))
                operand = False
            elif token == ")":
                while held and held[-1][1] != "(":
                    steps.append(held.pop())
                if not held or not operand:
                    raise Unread(token)
                held.pop()
                if held and held[-1][0] == "call":
                    steps.append(held.pop())
            elif token == "!":
                if not operand:
                    raise Unread(token)
                steps.append(("call", "!"))
            elif not operand:
                if token not in "+-":
                    raise Unread(token)
                if token == "-":
                    held.append(("op", "neg"))
            else:
                p = PRIORITY[token]
                while held and held[-1][0] == "op" and held[-1][1] != "(" and (PRIORITY[held[-1][1]] > p or PRIORITY[held[-1][1]] == p and token != "^"):
                    steps.append(held.pop())
                held.append(("op", token))
                operand = False
        if not operand:
            raise Unread("an end without a value")
        steps.extend(reversed(held))
        return tuple(steps)
    except Unread:
        return None


def _modular(steps: tuple[tuple[str, str], ...], at: dict[str, int]) -> int:
    """The value modulo PRIME, unknowns as `at` has them. Numbers that stand for exponents are kept exactly beside, up to MOST_BITS."""
    stack: list[tuple[int, Fraction | None]] = []
    for kind, token in steps:
        if kind == "number":
            f = Fraction(token)
            stack.append((f.numerator * pow(f.denominator, -1, PRIME) % PRIME, f))
        elif kind == "symbol":
            stack.append((at[token], None))
        elif kind == "call":
            x, f = stack.pop()
            if token != "!" or f is None or f.denominator > 1 or not 0 <= f <= 500:
                raise Irrational(token)
            stack.append((math.factorial(int(f)) % PRIME, Fraction(math.factorial(int(f)))))
        elif token == "neg":
            x, f = stack.pop()
            stack.append((-x % PRIME, None if f is None else -f))
        else:
            (y, g), (x, f) = stack.pop(), stack.pop()
            exact = f is not None and g is not None
            if token == "^":
                if g is None or g.denominator > 1:
                    raise Irrational(token)
                n = int(g)
                if n < 0 and not x:
                    raise ZeroDivisionError
                small = exact and abs(n) * max(f.numerator.bit_length(), f.denominator.bit_length()) < MOST_BITS
                stack.append((pow(x, n, PRIME), f**n if small else None))
                continue
            if token == "/":
                if not y:
                    raise ZeroDivisionError
                value, both = x * pow(y, -1, PRIME) % PRIME, f / g if exact else None
            elif token == "*":
                value, both = x * y % PRIME, f * g if exact else None
            else:
                sign = 1 if token == "+" else -1
                value, both = (x + sign * y) % PRIME, f + sign * g if exact else None
            stack.append((value, both if both is not None and max(both.numerator.bit_length(), both.denominator.bit_length()) < MOST_BITS else None))
    return stack[0][0]


def _numeric(steps: tuple[tuple[str, str], ...], at: dict[str, complex]) -> complex:
    stack: list[complex] = []
    for kind, token in steps:
        if kind == "number":
            stack.append(complex(float(token)))
        elif kind == "symbol":
            stack.append(at[token])
        elif token == "!":
            x = stack.pop()
            if x.imag or x.real != int(x.real) or not 0 <= x.real <= 170:
                raise ValueError(token)
            stack.append(complex(math.factorial(int(x.real))))
        elif kind == "call":
            stack.append(complex(FUNCTIONS[token](stack.pop())))
        elif token == "neg":
            stack.append(-stack.pop())
        else:
            y, x = stack.pop(), stack.pop()
            stack.append(x + y if token == "+" else x - y if token == "-" else x * y if token == "*" else x / y if token == "/" else x**y)
    if not cmath.isfinite(stack[0]):
        raise OverflowError
    return stack[0]


CONSTANTS = {"pi": math.pi, "e": math.e, "i": 1j}


def unknowns(steps: tuple[tuple[str, str], ...]) -> set[str]:
    return {t for k, t in steps if k == "symbol"} - CONSTANTS.keys()


def formula(text: str) -> float | None:
    """The value of a formula of numbers, pi and e without unknowns; None for anything else, and for what is not a real number."""
    steps = read(text)
    if steps is None or unknowns(steps):
        return None
    try:
        out = _numeric(steps, CONSTANTS)
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
    return out.real if abs(out.imag) <= CLOSE * max(1.0, abs(out)) and "i" not in {t for _, t in steps} else None


def identical(a: str, b: str, seed: int = 11) -> bool:
    """Whether two formulas are the same function of their unknowns; e and pi count as themselves, i as the root of -1."""
    p, q = read(a), read(b)
    if p is None or q is None:
        return False
    names = sorted({t for k, t in p + q if k == "symbol"})
    draw = random.Random(seed)
    try:
        for _ in range(POINTS):
            at = {x: IMAGINARY if x == "i" else draw.randrange(1, PRIME) for x in names}
            if _modular(p, at) != _modular(q, at):
                return False
        return True
    except ZeroDivisionError:
        return False
    except Irrational:
        pass
    met = 0
    for _ in range(3 * POINTS):
        at = {x: CONSTANTS.get(x, complex(draw.uniform(0.3, 2.5) * draw.choice((-1, 1)))) for x in names}
        try:
            x, y = _numeric(p, at), _numeric(q, at)
        except (ValueError, ZeroDivisionError, OverflowError):
            continue  # not defined here
        if abs(x - y) > CLOSE * max(1.0, abs(x), abs(y)):
            return False
        met += 1
    return met >= POINTS
