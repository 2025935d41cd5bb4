"""Declared schemas of the raw and staged tables; nothing is inferred from files."""

OBSERVATIONS_RAW = "DATE string, ID long, CURRENT_WATER string"
ENTITIES_RAW = "ID long, SCOPE_NAME string, RESERVOIR_NAME string, TOTAL_WATER string, ELECTRIC_FLAG int"
DETAILS_RAW = ("CODE string, NAME string, RESERVOIR string, X string, Y string, BASIN string, RIVERBED string, "
               "GOOGLE string, OPENSTREETMAP string, WIKIDATA string, PROVINCE string, AUTONOMOUS_COMMUNITY string, "
               "TYPE string, CREST_ELEVATION string, DAM_HEIGHT string, REPORT string")
PANEL = "id long, date date, storage double, storage_imputed int"
# A forecast step, or with an error and no step a model that failed
FORECASTS = "id long, digest string, model string, h int, date date, prediction double, error string"
METRICS = ("id long, origin int, model string, test_start date, mae double, rmse double, mape double, "
           "nmae_capacity double, nrmse_capacity double, configuration string, split string")
PREDICTIONS = ("id long, origin int, model string, h int, date date, actual double, prediction double, "
               "configuration string, split string")
FAILURES = "id long, origin int, model string, error string, configuration string, split string"
MANIFESTS = ("split string, id long, configuration string, status string, models array<string>, horizon int, "
             "origins int, include_ensemble boolean, completed_origins array<int>, "
             "failures array<struct<model: string, origin: int, error: string>>, failure_recorded boolean, "
             "generated_at_utc timestamp")
