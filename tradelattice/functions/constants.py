"""Code lists, column lists and defaults that results depend on."""

# ISO3 codes of aggregates in the country-product-year table.
EXPORT_AGGREGATES = ["AFR", "AMR", "ANT", "EUN", "EUR", "OAS", "OCE", "WLD", "XXB", "XXX"]

# ISO3 codes of aggregates in the bilateral table.
FLOW_AGGREGATES = ["AFR", "AMR", "ANT", "EUN", "EUR", "OAS", "OCE", "WLD"]

# M49 codes of aggregates (world, areas not elsewhere specified, groups).
AGGREGATE_M49 = [0, 97, 290, 473, 490, 527, 568, 577, 636, 637, 838, 839, 899]

# Country sets.
CEFTA = ["ALB", "BIH", "MDA", "MKD", "MNE", "SRB", "XKX"]
WESTERN_BALKANS = ["ALB", "BIH", "MKD", "MNE", "SRB", "XKX"]
FOCUS_COUNTRY = "MKD"

# Yearly export total the validation report compares with, in USD.
EXPORT_BENCHMARK = 8.0e9

# Inclusive year ranges of the sources.
EXPORT_YEARS = (2000, 2022)
FLOW_YEARS = (2015, 2022)
GRAVITY_YEARS = (2000, 2020)

# Input column names, their output names, and the numeric columns kept.
EXPORT_RENAMES = {"country_iso3_code": "iso3", "product_hs92_code": "hs4", "distance": "density"}
EXPORT_NUMERIC = [
    "export_value", "import_value", "export_rca", "eci", "pci", "density", "cog", "coi", "diversity",
]
FLOW_RENAMES = {
    "period": "year", "reportercode": "reporter_m49", "partnercode": "partner_m49", "cmdcode": "hs_code",
    "flowcode": "flow", "primaryvalue": "value", "fobvalue": "fob_value", "cifvalue": "cif_value",
}
TOTAL_RENAMES = {
    "period": "year", "reportercode": "reporter_m49", "cmdcode": "hs_code", "primaryvalue": "export_value", "fobvalue": "export_value",
}
GRAVITY_COLUMNS = [
    "year", "iso3_o", "iso3_d", "dist", "contig", "comlang_off", "comcol", "col45", "fta_wto",
    "gdp_o", "gdp_d", "pop_o", "pop_d",
]
WDI_INDICATORS = ["gdp", "gdp_pc", "population"]

# Edge types of the trade graph.
RELATIONS = ["EXPORTS", "IMPORTS", "TRADES_WITH", "SHIPS", "PROXIMITY", "IN_SECTION", "NEIGHBOR_OF"]

# Model and split defaults.
SEED = 42
EMBEDDING_DIM = 64
FASTRP_ITERATIONS = 3
WALK_LENGTH = 80
WALKS_PER_NODE = 10
NEIGHBOUR_SAMPLES = [15, 10]
TRAIN_END_YEAR, VAL_YEAR, TEST_YEARS = 2019, 2020, [2021, 2022]
SPLIT_RATIOS = (0.85, 0.05, 0.10)
MLP_HIDDEN = 64
