"""Regular expressions and time formats of Python, as Spark's: translated from their parse, or refused."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.functions.times import ArgumentError

#: Classes as Python means them for Unicode text, as the inside of a Java class.
_WORD, _DIGIT = r"\p{L}\p{N}_", r"\p{Nd}"
_SPACE = r"\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ASCII = {"WORD": "A-Za-z0-9_", "DIGIT": "0-9", "SPACE": r"\t-\r\x20"}
_UNICODE = {"WORD": _WORD, "DIGIT": _DIGIT, "SPACE": _SPACE}
_ANYTHING = "(?s:.)"
_END = "(?![\\s\\S])"


def java_regex(pattern: str) -> str:
    """A Java expression that finds what Python's ``pattern`` finds, with its groups by number.

    Names of groups go.  What Java can't say (conditions on groups) is an ArgumentError, as is
    what Python doesn't understand.
    """
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        raise ArgumentError(f"not a regular expression: {pattern!r}: {e}") from e
    return _Translation(pattern).sequence(parsed, parsed.state.flags)


class _Translation:
    def __init__(self, pattern: str):
        self.pattern = pattern

    def refused(self, what: str) -> ArgumentError:
        return ArgumentError(f"not supported in a regular expression: {what} in {self.pattern!r}")

    def sequence(self, nodes, flags: int) -> str:
        return "".join(self.node(str(op), arg, flags) for op, arg in nodes)

    def node(self, op: str, arg, flags: int) -> str:
        if op == "LITERAL":
            return self.cased(_char(arg), flags)
        if op == "NOT_LITERAL":
            return f"(?:(?!{self.cased(_char(arg), flags)}){_ANYTHING})"
        if op == "ANY":
            return _ANYTHING if flags & re.DOTALL else r"[^\n]"
        if op == "IN":
            return self.members(arg, flags)
        if op == "AT":
            return self.place(str(arg), flags)
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            upper = "" if most is re._constants.MAXREPEAT or most >= 4294967295 else str(int(most))
            sign = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}[op]
            return f"(?:{self.sequence(inner, flags)}){{{least},{upper}}}{sign}"
        if op == "SUBPATTERN":
            group, added, removed, inner = arg
            return ("(" if group else "(?:") + self.sequence(inner, (flags | added) & ~removed) + ")"
        if op == "ATOMIC_GROUP":
            return f"(?>{self.sequence(arg, flags)})"
        if op == "BRANCH":
            return "(?:" + "|".join(self.sequence(x, flags) for x in arg[1]) + ")"
        if op in ("ASSERT", "ASSERT_NOT"):
            way, inner = arg
            return f"(?{'<' if way < 0 else ''}{'=' if op == 'ASSERT' else '!'}{self.sequence(inner, flags)})"
        if op == "GROUPREF":
            return self.cased(f"(?:\\{arg})", flags)
        raise self.refused(op.lower())

    def cased(self, text: str, flags: int) -> str:
        return f"(?iu:{text})" if flags & re.IGNORECASE and not flags & re.ASCII else f"(?i:{text})" if flags & re.IGNORECASE else text

    def members(self, members, flags: int) -> str:
        """A class.  Negated parts stand beside it as alternatives, so that no class is nested."""
        kinds = _ASCII if flags & re.ASCII else _UNICODE
        inside, beside, negated = "", [], False
        for op, arg in members:
            name = str(op)
            if name == "NEGATE":
                negated = True
            elif name == "LITERAL":
                inside += _char(arg)
            elif name == "RANGE":
                inside += f"{_char(arg[0])}-{_char(arg[1])}"
            elif name == "CATEGORY":
                kind = str(arg).removeprefix("CATEGORY_").removeprefix("UNI_")
                if kind.startswith("NOT_"):
                    beside.append(f"[^{kinds[kind.removeprefix('NOT_')]}]")
                else:
                    inside += kinds[kind]
            else:
                raise self.refused(name.lower())
        parts = [self.cased(f"[{inside}]", flags)] * bool(inside) + beside
        one = "(?:" + "|".join(parts) + ")" if len(parts) != 1 else parts[0]
        return f"(?:(?!{one}){_ANYTHING})" if negated else one

    def place(self, place: str, flags: int) -> str:
        word = f"[{(_ASCII if flags & re.ASCII else _UNICODE)['WORD']}]"
        boundary = f"(?<={word})(?!{word})|(?<!{word})(?={word})"
        if place == "AT_BEGINNING":
            return r"(?:(?<![\s\S])|(?<=\n))" if flags & re.MULTILINE else r"(?<![\s\S])"
        if place == "AT_BEGINNING_STRING":
            return r"(?<![\s\S])"
        if place == "AT_END":
            return rf"(?:(?=\n)|{_END})" if flags & re.MULTILINE else rf"(?=\n?{_END})"
        if place == "AT_END_STRING":
            return _END
        if "NON_BOUNDARY" in place:
            return f"(?!{boundary})"
        if "BOUNDARY" in place:
            return f"(?:{boundary})"
        raise self.refused(place.lower())


def _char(code: int) -> str:
    c = chr(code)
    return c if c.isascii() and c.isalnum() else f"\\x{{{code:X}}}"


#: Directives of a time format, as an expression with one group; fixed values.
_DIRECTIVES = {
    "Y": r"(\d{4})",
    "y": r"(\d{2})",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])",
    "H": r"(2[0-3]|[01]\d|\d)",
    "I": r"(1[0-2]|0[1-9]|[1-9]| [1-9])",
    "M": r"([0-5]\d|\d)",
    "S": r"([0-5]\d|\d)",
    "f": r"(\d{1,6})",
    "j": r"(36[0-6]|3[0-5]\d|[12]\d\d|0[1-9]\d|00[1-9]|[1-9]\d|0[1-9]|[1-9])",
    "p": "(am|pm)",
    "z": r"([+-]\d{2}:?[0-5]\d|(?-i:Z))",
    "Z": "(utc|gmt)",
    "b": "(" + "|".join(calendar.month_abbr[1:]) + ")",
    "B": "(" + "|".join(calendar.month_name[1:]) + ")",
    "a": "(" + "|".join(calendar.day_abbr) + ")",
    "A": "(" + "|".join(calendar.day_name) + ")",
}
_WHOLE = {"T": "%H:%M:%S", "R": "%H:%M", "F": "%Y-%m-%d", "D": "%m/%d/%y"}


class TimeFormat:
    """A format of ``strptime``'s directives: an expression for the whole text, and the time that its groups say."""

    def __init__(self, form: str):
        self.form, self.groups = form, {}
        for short, long in _WHOLE.items():
            form = re.sub(rf"(?<!%)((?:%%)*)%{short}", lambda m, long=long: m[1] + long, form)
        out, at = "", 0
        while at < len(form):
            c = form[at]
            if c == "%":
                at += 1
                name = form[at : at + 1]
                if name == "%":
                    out += "%"
                elif name not in _DIRECTIVES:
                    raise ArgumentError(f"unknown directive %{name} in the time format {self.form!r}")
                elif name in self.groups:
                    raise ArgumentError(f"%{name} stands twice in the time format {self.form!r}")
                else:
                    self.groups[name] = len(self.groups) + 1
                    out += _DIRECTIVES[name]
            elif c.isspace():
                out += r"\s+" if not out.endswith(r"\s+") else ""
            else:
                out += _char(ord(c))
            at += 1
        if not {"Y", "y"} & set(self.groups):
            raise ArgumentError(f"the time format {self.form!r} has no year")
        if "j" not in self.groups and not ({"d"} <= set(self.groups) and {"m", "b", "B"} & set(self.groups)):
            raise ArgumentError(f"the time format {self.form!r} has no date")
        if "I" in self.groups and "p" not in self.groups:
            raise ArgumentError(f"the time format {self.form!r} has hours up to 12 without %p")
        self.java = rf"(?si)^{out}$(?!\n)"

    def part(self, text: Column, name: str) -> Column:
        return F.regexp_extract(text, self.java, self.groups[name])

    def number(self, text: Column, *names: str, usual: int = 0) -> Column:
        for name in names:
            if name in self.groups:
                # Where nothing fits, parts are empty.
                return F.trim(self.part(text, name)).try_cast("int")
        return F.lit(usual)

    def naive(self, text: Column) -> Column:
        """The time without a zone; null where the text doesn't fit, or there is no such day."""
        year = self.number(text, "Y")
        if "y" in self.groups:
            short = self.number(text, "y")
            year = short + F.when(short < 69, 2000).otherwise(1900)
        month = self.number(text, "m", usual=1)
        for name, names in (("b", calendar.month_abbr), ("B", calendar.month_name)):
            if name in self.groups:
                month = F.array_position(F.array(*[F.lit(n.lower()) for n in names[1:]]), F.lower(self.part(text, name))).cast("int")
        hour = self.number(text, "H")
        if "I" in self.groups:
            hour = self.number(text, "I") % 12 + F.when(F.lower(self.part(text, "p")) == "pm", 12).otherwise(0)
        fraction = F.rpad(self.part(text, "f"), 6, "0") if "f" in self.groups else F.lit("0")
        second = F.concat(self.number(text, "S").cast("string"), F.lit("."), fraction).try_cast("decimal(8,6)")
        day = self.number(text, "d", usual=1)
        if "j" in self.groups and "d" not in self.groups:
            first = F.try_make_timestamp_ntz(year, F.lit(1), F.lit(1), hour, self.number(text, "M"), second)
            moved = first + F.make_dt_interval(self.number(text, "j") - 1)
            # As elsewhere, the 366th day of a shorter year is the next year's first.
            found = moved
        else:
            found = F.try_make_timestamp_ntz(year, month, day, hour, self.number(text, "M"), second)
        return F.when(text.rlike(self.java), found)

    def zone(self, text: Column, usual: str) -> Column:
        """The zone that the text names, or the usual one."""
        if "z" in self.groups:
            named = self.part(text, "z")
            return F.when(named == "Z", "UTC").when(F.length(named) == 5, F.concat(F.substring(named, 1, 3), F.lit(":"), F.substring(named, 4, 2))).when(named != "", named).otherwise(usual)
        return F.lit(usual)
