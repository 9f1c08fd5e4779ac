from tillroll.plans.customers import (
    churn_risk,
    cohort_retention,
    customer_clv,
    kpi_summary,
    rfm_scores,
    rfm_segments,
    top_customers,
)
from tillroll.plans.exploration import data_quality, dataset_overview, revenue_distribution
from tillroll.plans.products import (
    category_performance,
    market_basket,
    monthly_profit,
    product_profit,
    seasonal_performance,
    top_products,
)
from tillroll.plans.segments import (
    age_groups,
    gender_patterns,
    payment_methods,
    regional_performance,
    sales_by_city,
    shipping,
)
from tillroll.plans.trends import (
    day_of_week_sales,
    monthly_sales,
    quarterly_growth,
    revenue_moving_avg,
)

__all__ = [
    "age_groups",
    "category_performance",
    "churn_risk",
    "cohort_retention",
    "customer_clv",
    "data_quality",
    "dataset_overview",
    "day_of_week_sales",
    "gender_patterns",
    "kpi_summary",
    "market_basket",
    "monthly_profit",
    "monthly_sales",
    "payment_methods",
    "product_profit",
    "quarterly_growth",
    "regional_performance",
    "revenue_distribution",
    "revenue_moving_avg",
    "rfm_scores",
    "rfm_segments",
    "sales_by_city",
    "seasonal_performance",
    "shipping",
    "top_customers",
    "top_products",
]
