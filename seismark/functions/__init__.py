"""Numeric kernels and feature modules evaluated within one series. Importing the package registers every module, on workers as well."""

from . import packs  # noqa: F401
