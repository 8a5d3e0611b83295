"""All built-in scalar functions."""

from tallyforge.functions import dates, hashing, lists, logic, strings, urls  # noqa: F401
