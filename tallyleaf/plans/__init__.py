"""The registered queries. Importing this package registers them."""

from . import decode, functions, helpers, items, scales, stores, trials  # noqa: F401
