"""Synthetic baskets for the golden request cases (business-table schemas)."""

from datetime import datetime, timedelta

TX_SCHEMA = ("id bigint, store_id int, cash_desk int, transaction_start timestamp_ntz, transaction_end timestamp_ntz, "
             "total_amount double, payment_medium string, customer_feedback int, damage double, label string, n_lines bigint")
LINE_SCHEMA = ("id int, transaction_id bigint, product_id bigint, timestamp timestamp_ntz, pieces_or_weight double, "
               "sales_price double, was_voided boolean, camera_product_similar boolean, camera_certainty double")
PRODUCT_SCHEMA = "id bigint, category string, price double, popularity double, sold_by_weight boolean, age_restricted boolean"
STORE_SCHEMA = "id int, location string, urbanization string, sco_introduction string"

T0 = datetime(2024, 3, 4, 9, 0, 0)
PRODUCTS = [
    (1, "BEVERAGES", 2.0, 0.5, False, False),
    (2, "SNACKS", 3.0, 0.4, False, False),
    (3, "DAIRY", 1.5, 0.9, True, False),
    (4, "ALCOHOL", 10.0, 0.2, False, True),
]
STORES = [(1, "Berlin", "CITIES", "2022-01-15"), (2, "Kassel", "TOWNS", "2023-06-01")]


def tx(i, store=2, cash="CREDIT_CARD", total=10.0, n=1, start=T0, label="UNKNOWN"):
    return (i, store, 1, start, start + timedelta(minutes=5), total, cash, None, 0.0, label, n)


def line(tid, i, pid, price, qty=1.0, voided=False, similar=True, cert=0.9, t=T0, dt=10):
    return (i, tid, pid, t + timedelta(seconds=dt * i), qty, price, voided, similar, cert)
