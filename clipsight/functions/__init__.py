"""Column expressions: everything here is Column -> Column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain Column used five times inside branches may be evaluated five times;
    binding it as a lambda variable of a one-element array avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# White space as the workflow's text files understand it (Unicode, and the separators x1c-x1f).
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
          "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.trim(text, F.lit(BLANKS))


def put_first(new: Column, old: Column) -> Column:
    """Both arrays in one, ``new`` first, later repeats dropped."""
    return F.array_distinct(F.concat(new, old))
