"""The mechanism catalogue, subject pools, grids and weights of the economic-impact contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the data contract.
FACTORS = [
    "input_dependency",
    "output_dependency",
    "demand_exposure",
    "hedging",
    "pricing_power",
    "substitutability",
    "inventory_buffer",
    "supplier_diversification",
    "customer_concentration",
    "debt_ratio",
    "cash_buffer",
    "currency_revenue_exposure",
    "currency_cost_exposure",
    "regulatory_exposure",
    "tax_exposure",
    "subsidy_exposure",
    "competitive_pressure",
    "contract_revenue_share",
    "labor_intensity",
    "capacity_utilization",
    "fixed_cost_share",
]
STATES = ["revenue_expectation", "demand", "operating_costs", "margin_expectation", "supply_risk", "competitive_position"]
WEIGHTS = dict(zip(STATES, [0.75, 0.50, -0.75, 1.00, -0.50, 0.25], strict=True))
DIRECTIONS = ["increase", "decrease"]
HORIZONS = [7, 14, 30, 60, 90, 180, 365]
RATIO_GRID = [0.0, 0.25, 0.5, 0.75, 1.0]
MAGNITUDE_GRID = [0.1, 0.3, 0.5, 0.7, 0.9]
HORIZON_GRID = [7, 30, 90, 180, 365]
SPLITS = ["train", "validation", "test_iid", "test_entity_ood", "test_parameter_ood", "test_combination_ood", "test_hard_ood", "test_concept_ood"]
OOD_PAIRS = [
    ("input_dependency", "hedging"),
    ("debt_ratio", "cash_buffer"),
    ("pricing_power", "competitive_pressure"),
    ("currency_revenue_exposure", "currency_cost_exposure"),
    ("customer_concentration", "pricing_power"),
]
CONCEPT_SUBJECTS = {
    "wheat": "agricultural_input",
    "electricity": "energy",
    "freight": "logistics",
    "cloud_compute": "compute",
    "semiconductor_wafers": "materials",
}
INDEPENDENT_SOURCES = ["teacher", "curated", "real"]
POOLS = {
    "production_input": ["oil", "gas", "copper", "steel", "lithium", "aluminum", "nickel", "rare_earth", "timber", "chemicals"],
    "energy": ["oil", "gas", "coal", "diesel", "jet_fuel", "natural_gas"],
    "agricultural_input": ["corn", "soybeans", "cotton", "sugar", "palm_oil"],
    "materials": ["steel", "aluminum", "copper", "plastics", "glass", "cement", "paper", "packaging"],
    "compute": ["gpu_compute", "server_capacity", "data_center_power"],
    "logistics": ["shipping", "trucking", "rail", "air_cargo", "port_services", "warehousing"],
    "financing": ["interest_rate", "credit_spreads", "corporate_bonds", "bank_loans", "commercial_paper"],
    "debt": ["corporate_bonds", "bank_loans", "commercial_paper"],
    "credit": ["credit_spreads", "bank_loans"],
    "interest_rate": ["interest_rate", "central_bank_rate"],
    "labor": ["skilled_workers", "engineers", "logistics_staff", "factory_workers", "software_developers"],
    "workforce": ["skilled_workers", "factory_workers", "engineers"],
    "occupation": ["engineers", "software_developers", "healthcare_staff"],
    "compensation": ["wages", "benefits", "bonuses"],
    "output": ["steel", "aluminum", "copper", "cement", "chemicals", "paper", "glass", "plastics", "textiles", "packaging"],
    "product": ["electric_vehicles", "semiconductors", "solar_panels", "consumer_electronics", "batteries", "wind_turbines", "smartphones", "machinery"],
    "service": ["cloud_services", "logistics_services", "consulting", "software_subscriptions", "maintenance"],
    "commodity": ["oil", "gas", "copper", "steel", "lithium", "aluminum", "nickel", "corn", "soybeans"],
    "market": ["ev_market", "semiconductor_market", "steel_market", "energy_market", "consumer_market"],
    "customer_segment": ["automotive_oems", "industrial_customers", "retail_consumers", "enterprise_clients", "construction_sector"],
    "market_supply": ["oil_supply", "copper_supply", "steel_supply", "lithium_supply", "semiconductor_supply"],
    "currency": ["usd", "eur", "jpy", "gbp", "chf", "aud", "cad", "brl", "inr", "cny"],
    "currency_pair": ["usd_eur", "usd_jpy", "usd_cny", "eur_gbp"],
    "foreign_exchange": ["usd", "eur", "jpy", "cny"],
    "competitor": ["low_cost_entrant", "foreign_competitor", "platform_competitor", "private_label", "substitute_product"],
    "regulation": ["emissions_rule", "safety_standard", "data_privacy_law", "import_quota", "packaging_rule"],
    "jurisdiction": ["eu", "us", "china", "germany", "california"],
    "compliance_requirement": ["emissions_reporting", "product_certification", "data_residency", "import_licensing"],
    "tax": ["corporate_tax", "vat", "carbon_tax", "import_tariff", "windfall_tax"],
    "tax_regime": ["corporate_tax", "carbon_tax", "import_tariff"],
    "subsidy": ["ev_subsidy", "solar_subsidy", "export_credit", "r_and_d_credit", "energy_subsidy"],
    "government_program": ["ev_subsidy", "solar_subsidy", "export_credit", "r_and_d_credit"],
    "company": ["smelter", "refinery", "fab", "assembly_plant", "warehouse", "data_center", "mine", "port", "fleet", "grid"],
    "facility": ["smelter", "refinery", "fab", "assembly_plant", "warehouse", "data_center", "mine", "port"],
    "production_line": ["assembly_line", "packaging_line", "chemical_line", "steel_line"],
    "network": ["logistics_network", "retail_network", "power_grid", "telecom_network"],
    "supplier": ["chip_supplier", "battery_supplier", "steel_supplier", "chemical_supplier", "logistics_provider", "component_supplier", "rare_earth_supplier", "packaging_supplier"],
    "logistics_route": ["suez_route", "panama_route", "transpacific_route", "europe_rail_route"],
    "customer": ["major_retailer", "oem_customer", "government_customer", "telecom_operator", "auto_manufacturer", "distributor", "ecommerce_platform"],
    "distribution_channel": ["retail_channel", "ecommerce_channel", "wholesale_channel", "direct_sales"],
    "contract": ["supply_contract", "offtake_agreement", "service_contract", "licensing_deal", "procurement_contract"],
    "customer_contract": ["supply_contract", "service_contract", "licensing_deal"],
    "supplier_contract": ["procurement_contract", "offtake_agreement", "supply_contract"],
}


@dataclass(frozen=True)
class Mechanism:
    """One transmission mechanism: what it needs, what it changes, by which formulas, and the signs that must hold.

    terms: named intermediate expressions, each in those before it. effects: by state, in terms, factors, sign (of the
    direction), magnitude and the exposures inventory_exposure, liquidity_exposure and residual_exposure. All are SQL.
    signs: +1 or -1, that of the effect times the direction.
    """

    name: str
    classes: list[str]
    factors: list[str]
    terms: dict[str, str]
    effects: dict[str, str]
    signs: dict[str, int]


#: In contract order.
MECHANISMS = [
    Mechanism(
        name="input_cost_change",
        classes=["production_input", "energy", "agricultural_input", "materials", "compute", "logistics"],
        factors=["input_dependency", "hedging", "pricing_power", "substitutability", "inventory_buffer"],
        terms={
            "transmitted_cost": "sign * magnitude * input_dependency * (1 - hedging) * (1 - substitutability) * inventory_exposure",
            "unpassed_cost": "transmitted_cost * (1 - pricing_power)",
        },
        effects={
            "operating_costs": "transmitted_cost",
            "margin_expectation": "-unpassed_cost",
            "supply_risk": "0.10 * transmitted_cost",
            "competitive_position": "-0.25 * unpassed_cost",
        },
        signs={"operating_costs": 1, "margin_expectation": -1, "supply_risk": 1, "competitive_position": -1},
    ),
    Mechanism(
        name="output_price_change",
        classes=["output", "product", "service", "commodity"],
        factors=["output_dependency", "demand_exposure", "pricing_power"],
        terms={
            "price_move": "sign * magnitude * output_dependency",
            "realised_revenue": "price_move * (0.55 + 0.45 * pricing_power * sign)",
            "lost_demand": "-sign * magnitude * demand_exposure * output_dependency * (1 - pricing_power) * 0.35",
        },
        effects={
            "revenue_expectation": "realised_revenue",
            "demand": "lost_demand",
            "margin_expectation": "realised_revenue + 0.20 * lost_demand",
            "competitive_position": "0.20 * (realised_revenue + lost_demand)",
        },
        signs={"revenue_expectation": 1, "demand": -1},
    ),
    Mechanism(
        name="demand_change",
        classes=["product", "service", "market", "customer_segment"],
        factors=["demand_exposure", "pricing_power", "capacity_utilization"],
        terms={
            "demand_move": "sign * magnitude * demand_exposure",
            "sold_demand": "demand_move * (CASE WHEN demand_move >= 0 THEN (0.55 + 0.45 * pricing_power) * (1 - 0.60 * capacity_utilization) ELSE 1 - 0.50 * pricing_power END)",
        },
        effects={
            "revenue_expectation": "sold_demand",
            "demand": "demand_move",
            "margin_expectation": "sold_demand * (0.55 + 0.45 * pricing_power)",
        },
        signs={"revenue_expectation": 1, "demand": 1, "margin_expectation": 1},
    ),
    Mechanism(
        name="supply_change",
        classes=["production_input", "product", "commodity", "market_supply"],
        factors=["input_dependency", "inventory_buffer", "supplier_diversification", "substitutability"],
        terms={
            "available_supply": "sign * magnitude * input_dependency * residual_exposure",
        },
        effects={
            "revenue_expectation": "0.35 * available_supply",
            "operating_costs": "-0.55 * available_supply",
            "margin_expectation": "0.65 * available_supply",
            "supply_risk": "-available_supply",
        },
        signs={"revenue_expectation": 1, "operating_costs": -1, "margin_expectation": 1, "supply_risk": -1},
    ),
    Mechanism(
        name="capacity_change",
        classes=["company", "facility", "production_line", "network"],
        factors=["capacity_utilization", "demand_exposure", "fixed_cost_share"],
        terms={
            "usable_capacity": "sign * magnitude * demand_exposure * (0.25 + 0.75 * capacity_utilization)",
            "fixed_cost": "sign * magnitude * fixed_cost_share * 0.25",
        },
        effects={
            "revenue_expectation": "0.80 * usable_capacity",
            "operating_costs": "fixed_cost",
            "margin_expectation": "0.65 * usable_capacity - 0.50 * fixed_cost",
            "supply_risk": "-0.50 * usable_capacity",
        },
        signs={"revenue_expectation": 1, "operating_costs": 1, "supply_risk": -1},
    ),
    Mechanism(
        name="supplier_disruption",
        classes=["supplier", "facility", "logistics_route", "production_input"],
        factors=["input_dependency", "inventory_buffer", "supplier_diversification", "substitutability"],
        terms={
            "exposed_supply": "sign * magnitude * input_dependency * residual_exposure",
        },
        effects={
            "revenue_expectation": "-0.55 * exposed_supply",
            "operating_costs": "0.50 * exposed_supply",
            "margin_expectation": "-0.70 * exposed_supply",
            "supply_risk": "exposed_supply",
        },
        signs={"revenue_expectation": -1, "operating_costs": 1, "margin_expectation": -1, "supply_risk": 1},
    ),
    Mechanism(
        name="customer_dependency_change",
        classes=["customer", "customer_segment", "distribution_channel"],
        factors=["customer_concentration", "demand_exposure", "pricing_power"],
        terms={
            "customer_revenue": "sign * magnitude * customer_concentration",
        },
        effects={
            "revenue_expectation": "customer_revenue",
            "demand": "sign * magnitude * demand_exposure",
            "margin_expectation": "customer_revenue * (0.55 + 0.45 * pricing_power * sign)",
            "competitive_position": "-customer_revenue * (1 - pricing_power) * 0.25",
        },
        signs={"revenue_expectation": 1, "demand": 1, "margin_expectation": 1, "competitive_position": -1},
    ),
    Mechanism(
        name="financing_cost_change",
        classes=["financing", "debt", "credit", "interest_rate"],
        factors=["debt_ratio", "cash_buffer", "hedging", "fixed_cost_share"],
        terms={
            "gross_cost": "sign * magnitude * debt_ratio * (1 - hedging)",
            "absorbed_cost": "CASE WHEN gross_cost > 0 THEN gross_cost * liquidity_exposure ELSE gross_cost END",
        },
        effects={
            "revenue_expectation": "-0.25 * absorbed_cost * fixed_cost_share",
            "margin_expectation": "-absorbed_cost",
            "competitive_position": "-absorbed_cost * (0.25 + 0.35 * fixed_cost_share)",
        },
        signs={"revenue_expectation": -1, "margin_expectation": -1, "competitive_position": -1},
    ),
    Mechanism(
        name="currency_change",
        classes=["currency", "currency_pair", "foreign_exchange"],
        factors=["currency_revenue_exposure", "currency_cost_exposure", "hedging", "pricing_power"],
        terms={
            "open_exposure": "sign * magnitude * (1 - hedging)",
            "revenue_move": "open_exposure * currency_revenue_exposure",
            "cost_move": "open_exposure * currency_cost_exposure",
            "net_move": "revenue_move - cost_move * (1 - 0.65 * pricing_power * sign)",
        },
        effects={
            "revenue_expectation": "revenue_move",
            "operating_costs": "cost_move",
            "margin_expectation": "net_move",
            "competitive_position": "0.25 * net_move",
        },
        signs={},
    ),
    Mechanism(
        name="regulatory_cost_change",
        classes=["regulation", "jurisdiction", "compliance_requirement"],
        factors=["regulatory_exposure", "pricing_power", "cash_buffer"],
        terms={
            "gross_cost": "sign * magnitude * regulatory_exposure",
            "absorbed_cost": "CASE WHEN gross_cost > 0 THEN gross_cost * liquidity_exposure ELSE gross_cost END",
            "unpassed_cost": "absorbed_cost * (1 - pricing_power)",
        },
        effects={
            "operating_costs": "absorbed_cost",
            "margin_expectation": "-unpassed_cost",
            "competitive_position": "-0.30 * unpassed_cost",
        },
        signs={"operating_costs": 1, "margin_expectation": -1, "competitive_position": -1},
    ),
    Mechanism(
        name="tax_change",
        classes=["tax", "jurisdiction", "tax_regime"],
        factors=["tax_exposure", "pricing_power", "cash_buffer"],
        terms={
            "gross_tax": "sign * magnitude * tax_exposure",
            "absorbed_tax": "CASE WHEN gross_tax > 0 THEN gross_tax * liquidity_exposure ELSE gross_tax END",
        },
        effects={
            "margin_expectation": "-absorbed_tax * (1 - 0.35 * pricing_power)",
            "competitive_position": "-0.25 * absorbed_tax * (1 - pricing_power)",
        },
        signs={"margin_expectation": -1, "competitive_position": -1},
    ),
    Mechanism(
        name="subsidy_change",
        classes=["subsidy", "government_program", "jurisdiction"],
        factors=["subsidy_exposure", "cash_buffer", "pricing_power"],
        terms={
            "gross_support": "sign * magnitude * subsidy_exposure",
            "absorbed_support": "CASE WHEN gross_support < 0 THEN gross_support * liquidity_exposure ELSE gross_support END",
        },
        effects={
            "revenue_expectation": "0.35 * absorbed_support",
            "operating_costs": "-0.65 * absorbed_support",
            "margin_expectation": "absorbed_support",
            "competitive_position": "0.30 * absorbed_support * (1 - 0.50 * pricing_power)",
        },
        signs={"revenue_expectation": 1, "operating_costs": -1, "margin_expectation": 1, "competitive_position": 1},
    ),
    Mechanism(
        name="competitive_pressure_change",
        classes=["competitor", "market", "product", "service"],
        factors=["competitive_pressure", "demand_exposure", "pricing_power", "customer_concentration"],
        terms={
            "pressure": "sign * magnitude * competitive_pressure",
            "vulnerability": "(1 - 0.65 * pricing_power) * (0.60 + 0.40 * customer_concentration)",
            "eroded_revenue": "pressure * demand_exposure * vulnerability",
        },
        effects={
            "revenue_expectation": "-eroded_revenue",
            "demand": "-pressure * demand_exposure * (0.70 + 0.30 * customer_concentration)",
            "margin_expectation": "-eroded_revenue * (0.70 + 0.30 * (1 - pricing_power))",
            "competitive_position": "-pressure * (1 - 0.40 * pricing_power)",
        },
        signs={"revenue_expectation": -1, "demand": -1, "margin_expectation": -1, "competitive_position": -1},
    ),
    Mechanism(
        name="contract_change",
        classes=["contract", "customer_contract", "supplier_contract"],
        factors=["contract_revenue_share", "customer_concentration", "pricing_power"],
        terms={
            "contract_revenue": "sign * magnitude * contract_revenue_share",
            "pass_through": "0.50 + 0.50 * pricing_power * sign",
        },
        effects={
            "revenue_expectation": "contract_revenue",
            "demand": "contract_revenue * (0.50 + 0.50 * customer_concentration)",
            "margin_expectation": "contract_revenue * pass_through",
            "competitive_position": "0.25 * contract_revenue * pass_through",
        },
        signs={"revenue_expectation": 1, "demand": 1, "margin_expectation": 1, "competitive_position": 1},
    ),
    Mechanism(
        name="labor_cost_change",
        classes=["labor", "workforce", "occupation", "compensation"],
        factors=["labor_intensity", "pricing_power", "fixed_cost_share"],
        terms={
            "labor_cost": "sign * magnitude * labor_intensity",
        },
        effects={
            "operating_costs": "labor_cost * (0.70 + 0.30 * fixed_cost_share)",
            "margin_expectation": "-labor_cost * (1 - 0.75 * pricing_power)",
            "supply_risk": "0.20 * labor_cost * fixed_cost_share",
            "competitive_position": "-0.25 * labor_cost * (1 - pricing_power)",
        },
        signs={"operating_costs": 1, "margin_expectation": -1, "supply_risk": 1, "competitive_position": -1},
    ),
]
BY_NAME = {m.name: m for m in MECHANISMS}


def mechanism(name: str) -> Mechanism:
    """Looks a mechanism up by its name, whatever its case and the blanks around it."""
    return BY_NAME[name.strip().casefold()]


def validate() -> None:
    """Rejects a catalogue that contradicts itself."""
    names = [m.name for m in MECHANISMS]
    assert len(set(names)) == len(names) == 15
    for m in MECHANISMS:
        assert set(m.factors) <= set(FACTORS) and len(set(m.factors)) == len(m.factors), m.name
        assert set(m.signs) <= set(m.effects) <= set(STATES), m.name
        assert set(m.classes) <= set(POOLS), m.name
    assert not {s for pool in POOLS.values() for s in pool} & set(CONCEPT_SUBJECTS)


def catalogue(spark: SparkSession) -> DataFrame:
    """One row per mechanism, in contract order; 15 rows, for broadcast."""
    concept = {c: s for s, c in CONCEPT_SUBJECTS.items()}
    rows = [
        (k, m.name, [(c, POOLS[c], concept.get(c)) for c in m.classes], m.factors, list(m.effects)) for k, m in enumerate(MECHANISMS)
    ]
    return spark.createDataFrame(
        rows, "ordinal int, mechanism string, classes array<struct<subject_class:string,pool:array<string>,concept:string>>, factors array<string>, affected array<string>"
    )


validate()
