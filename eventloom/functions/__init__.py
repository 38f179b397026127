"""Column functions; all of them stay inside the JVM."""

from .clean import finite, first_four_digits, lenient_date, lenient_double, lookup_code, pad_code, posix_path, securities_code
from .stats import normal_p

__all__ = ["finite", "first_four_digits", "lenient_date", "lenient_double", "lookup_code", "normal_p", "pad_code", "posix_path", "securities_code"]
