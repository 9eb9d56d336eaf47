"""Table schemas (as DDL, which readers take as they are) and business constants of the price model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    """Thresholds; every one can be replaced. Days, fractions and amounts in the currency's unit."""

    fresh_days: int = 7
    min_price: float = 500.0
    min_stores: int = 2
    valid_status: tuple[str, ...] = ("auto", "confirmed")
    auto_match: float = 0.82
    review_match: float = 0.65
    ean_conflict: float = 0.75
    suspect_pct: float = 80.0
    suspect_z: float = 4.0
    suspect_n: int = 5
    stats_days: int = 90
    outlier_min_ref: float = 250_000.0
    outlier_ratio: float = 5.0
    deal_threshold: float = 0.15
    deal_max: float = 0.8
    deal_cooldown_days: int = 14
    merge_name: float = 0.86
    reject_below: float = 0.45
    near_min: float = 1.05
    quarantine_failures: int = 3
    quarantine_hours: int = 24
    max_rejection: float = 0.2
    stale_hours: int = 72
    late_hours: int = 168
    retention_months: int = 13
    error_samples: int = 20


RULES = Rules()

SNAPSHOT = (
    "externalId string, url string, rawDescription string, description string, ean string, brand string, categoryPath array<string>, unitLabel string,"
    " price struct<amount: double, listOrPromo: string, promoLabel: string, unitPrice: double>, imageUrl string, capturedAt string"
)
STORE = ("id smallint, slug string, name string, base_url string, adapter_id string, is_active boolean, config struct<consecutiveFailures: int, quarantinedUntil: timestamp, extraHosts: array<string>>")
CATEGORY = ("id int, slug string, name string, parent_id int, path string")
PRODUCT = ("id bigint, slug string, canonical_name string, brand string, ean string, unit_amount decimal(10,3), unit_type string, category_id int, updated_at timestamp")
STORE_SKU = ("id bigint, store_id smallint, external_id string, url string, raw_description string, declared_ean string, last_seen_at timestamp, is_active boolean")
MATCH_LINK = ("store_sku_id bigint, product_id bigint, method string, score decimal(5,4), status string")
PRICE_RECORD = ("id bigint, store_sku_id bigint, price_amount decimal(12,2), currency string, list_or_promo string, unit_price decimal(12,3), source_url string, captured_at timestamp, run_id string, is_suspect boolean")
PRICE_CORRECTION = ("store_sku_id bigint, original_captured_at timestamp, reason string")
RUN_REPORT = ("run_id string, store_id smallint, started_at timestamp, finished_at timestamp, status string, skus_captured int, skus_rejected int, http_errors int, quarantined boolean, errors_sample array<struct<kind: string, reason: string, externalId: string, message: string>>")
TABLES = {"store": STORE, "category": CATEGORY, "product": PRODUCT, "store_sku": STORE_SKU, "match_link": MATCH_LINK, "price_record": PRICE_RECORD, "price_correction": PRICE_CORRECTION, "run_report": RUN_REPORT}
