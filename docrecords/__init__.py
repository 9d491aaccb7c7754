"""Web pages to hierarchical search records, as Spark DataFrame operators."""

from docrecords.plans.records import build_records
from docrecords.spec import Selector, SelectorSet, Spec, StartUrl

__all__ = ["Selector", "SelectorSet", "Spec", "StartUrl", "build_records"]
