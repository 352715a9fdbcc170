"""Report parameters that the reference hard-codes as SQL literals."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults that reproduce the reference's literals.
DEFAULT_CHANNELS = ("Organic Search", "Organic Shopping")
DEFAULT_SHOPPING_PATTERN = "%Shopping%"
DEFAULT_EXCLUDED_PATTERNS = ("%Germany%", "%Netherlands%")
DEFAULT_FIXED_SEO_COST = 2050.0
DEFAULT_PURCHASE_EVENT = "purchase"


@dataclass(frozen=True)
class ReportConfig:
    """Account and segment settings shared by all reports.

    ``customer_id`` selects the ads account; ``channels`` the organic channel
    groups; ``shopping_pattern`` / ``excluded_patterns`` are case-sensitive SQL
    ``LIKE`` patterns applied to the latest campaign name; ``fixed_seo_cost`` is
    the per-report SEO cost (not scaled to the period length).
    """

    customer_id: str
    channels: tuple[str, ...] = DEFAULT_CHANNELS
    shopping_pattern: str = DEFAULT_SHOPPING_PATTERN
    excluded_patterns: tuple[str, ...] = DEFAULT_EXCLUDED_PATTERNS
    fixed_seo_cost: float = DEFAULT_FIXED_SEO_COST
    purchase_event: str = DEFAULT_PURCHASE_EVENT

    def __post_init__(self):
        if not self.channels:
            raise ValueError("channels must not be empty")
        object.__setattr__(self, "channels", tuple(self.channels))
        object.__setattr__(self, "excluded_patterns", tuple(self.excluded_patterns))
