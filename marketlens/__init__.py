"""marketlens: product analytics for order-based marketplaces, as Spark DataFrame jobs.

    from marketlens import api, FilterSpec, KpiConfig
    kpi, charts = api.compute_all_kpis(api.filter_data(m, cuisines=["Italian"]))
"""

from marketlens.model import FilterSpec, KpiConfig, Marketplace

__version__ = "0.1.0"
__all__ = ["FilterSpec", "KpiConfig", "Marketplace", "__version__"]
