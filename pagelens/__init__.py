"""pagelens: page semantics over tables of captured HTML, on Spark.

Pipeline (all DataFrame operators except the structural parse):

    pages -> elements (+ frames) -> subjects (role, name, properties)
          -> nodes -> candidates -> match counts -> resolved locators
          -> extracts (one nested row per page) -> corpus reports
"""

from pagelens.session import get_spark
from pagelens.plans.extract import ExtractOptions, Extraction, extract

__all__ = ["get_spark", "ExtractOptions", "Extraction", "extract"]
