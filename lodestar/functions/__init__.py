from lodestar.functions.derive import brand_number, calendar, cents, city_name, ingest_date

__all__ = ["brand_number", "calendar", "cents", "city_name", "ingest_date"]
