"""Domain configuration.

Every constant the analytics depend on (domain filter, label lists, recode
maps, year windows, weights, model period) lives here as a frozen dataclass,
so jobs take it as a parameter instead of hard-coding it.  Two presets exist:

* ``surveillance_defaults()`` -- the weekly emergency-visit feed the engine was
  designed for (Spanish source labels and column names).
* ``driver_defaults()``       -- the same notions mapped onto the synthetic
  star-schema test tables (see FIXTURES.md section 3).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Engine column names (the master table schema uses these).
# ---------------------------------------------------------------------------
FACILITY = "facility"
AREA = "area"
REGION = "region"
CAUSE = "cause"
FACILITY_TYPE = "facility_type"
SERVICE = "service"
YEAR = "year"
WEEK = "week"
N_TOTAL = "n_total"
VISITS = "visits"
AGE_GROUP = "age_group"
POPULATION = "population"
RATE = "rate"
CARE_LEVEL = "care_level"
SCOPE = "scope"

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the source system's values for results to
# match; they are stated verbatim, in their natural order.
# ---------------------------------------------------------------------------

# Raw feed column names -> engine names.
FEED_COLUMNS = {
    "EstablecimientoGlosa": FACILITY,
    "ComunaGlosa": AREA,
    "RegionGlosa": REGION,
    "Causa": CAUSE,
    "TipoEstablecimiento": FACILITY_TYPE,
    "ServicioSaludGlosa": SERVICE,
    "Anio": YEAR,
    "SemanaEstadistica": WEEK,
    "NumTotal": N_TOTAL,
}

# Administrative columns removed after cleaning.
FEED_DROP_COLUMNS = (
    "EstablecimientoCodigo", "RegionCodigo", "ComunaCodigo", "ServicioSaludCodigo",
    "DependenciaAdministrativa", "TipoUrgencia", "NivelComplejidad", "OrdenCausa",
)

# Age-band count columns -> age-group label used by the population table.
FEED_AGE_COLUMNS = {
    "NumMenor1Anio": "Menor1Anio",
    "Num1a4Anios": "1a4Anios",
    "Num5a14Anios": "5a14Anios",
    "Num15a64Anios": "15a64Anios",
    "Num65oMas": "65oMas",
}

# Population file: optional lower-case names renamed to the canonical ones.
POPULATION_RENAMES = {"anio": "Anio", "poblacion": "Poblacion"}
POPULATION_COLUMNS = {"ComunaGlosa": AREA, "Anio": YEAR, "grupo_etario": AGE_GROUP,
                      "Poblacion": POPULATION}

FEED_SERVICE = "Servicio de Salud Talcahuano"

FEED_EXCLUDED_CAUSES = (
    "TOTAL CAUSA SISTEMA  RESPIRATORIO (J00-J98)",
    "- Por covid-19, virus no identificado U07.2",
    "- Por covid-19, virus identificado U07.1",
)

# Regex spelling dictionary, applied in this order to area, region, facility.
FEED_SPELLING = (
    ("Tome", "Tomé"),
    ("BíoBío", "BioBío"),
    ("Región Del Bíobío", "Región del BioBío"),
    ("Región del Bíobío", "Región del BioBío"),
)

# Exact-match cause recode (after trimming); unmapped causes are kept.
FEED_CAUSE_LABELS = (
    ("IRA Alta (J00-J06)", "IRA Alta"),
    ("Bronquitis/bronquiolitis aguda (J20-J21)", "Bronquiolitis"),
    ("Neumonía (J12-J18)", "Neumonía"),
    ("Crisis obstructiva bronquial (J40-J46)", "Crisis Obstructiva"),
    ("Influenza (J09-J11)", "Influenza"),
    ("TOTAL ATENCIONES POR COVID-19 Virus Identificado U07.1", "COVID"),
    ("TOTAL ATENCIONES POR COVID-19 Virus no Identificado U07.2", "SOSPECHA COVID"),
    ("Otra causa respiratoria no contenidas en las categorías anteriores "
     "(J22; J30-J39, J47, J60-J98)", "Otras IRA"),
    ("- Causas sistema respiratorio (J00-J98)", "Causas Totales"),
)

FEED_TARGET_CAUSES = ("IRA Alta", "Bronquiolitis", "Neumonía", "Influenza")

# Care-level classification: upper-cased substring keywords and labels.
HOSPITAL_KEYWORDS = ("HOSPITAL", "INSTITUTO")
PRIMARY_KEYWORDS = ("SAPU", "SAR", "SUR")
LEVEL_HOSPITAL = "Atención Hospitalaria"
LEVEL_PRIMARY = "Atención Primaria Urgencia"
LEVEL_OTHER = "Otros"

GLOBAL_SCOPE = "Global"

# Endemic-channel zones (strict "<" against Q1, Q2, Q3; else epidemic).
ZONE_SUCCESS = "ÉXITO"
ZONE_SAFETY = "SEGURIDAD"
ZONE_ALARM = "ALARMA"
ZONE_EPIDEMIC = "EPIDEMIA"
INSIGHT_SUCCESS = "Demanda inferior al histórico. Situación bajo control."
INSIGHT_SAFETY = "Comportamiento normal (bajo la mediana)."
INSIGHT_ALARM = "Se superó la mediana (Q2={}). Inicio de tensión."
INSIGHT_EPIDEMIC = "Exceso de demanda. Se supera el umbral crítico (Q3={})."
ACTION_SUCCESS = "Mantener vigilancia basal."
ACTION_SAFETY = "Vigilancia estándar."
ACTION_ALARM = "Alerta preventiva a la red."
ACTION_EPIDEMIC = "Activar Plan de Contingencia."

TREND_UP = "up"
TREND_DOWN = "down"
TREND_FLAT = "flat"

# P-Score sign labels and severity of the peak excess (thresholds 50, 20, 0).
PSCORE_EXCESS = "Exceso (+)"
PSCORE_DEFICIT = "Déficit (-)"
SEVERITY_BANDS = ((50.0, "ALERTA CRÍTICA"), (20.0, "PRECAUCIÓN"), (0.0, "ATENCIÓN"))
SEVERITY_NORMAL = "NORMALIDAD"

# Forecast model quality bands on MAPE (< 25 good, < 40 fair, else poor).
MAPE_BANDS = ((25.0, "good"), (40.0, "fair"))
MAPE_POOR = "poor"

# Smoothed-trend series names.
RAW_SERIES = "Tasa_Cruda"
SMOOTH_SERIES = "Tasa_Suavizada"

# Harmonic model: weeks per year and the number of fitted columns.
WEEKS_PER_YEAR = 52.1429
FORECAST_WEEKS = 52
RATE_SCALE = 10000.0


@dataclass(frozen=True)
class Config:
    """All domain parameters of a run."""

    service: str = FEED_SERVICE
    excluded_causes: tuple[str, ...] = FEED_EXCLUDED_CAUSES
    spelling: tuple[tuple[str, str], ...] = FEED_SPELLING
    spelling_columns: tuple[str, ...] = (AREA, REGION, FACILITY)
    age_columns: tuple[tuple[str, str], ...] = tuple(FEED_AGE_COLUMNS.items())
    drop_columns: tuple[str, ...] = FEED_DROP_COLUMNS
    cause_labels: tuple[tuple[str, str], ...] = FEED_CAUSE_LABELS
    target_causes: tuple[str, ...] = FEED_TARGET_CAUSES
    baseline_years: tuple[int, int] = (2014, 2019)
    excluded_years: tuple[int, ...] = (2020, 2021, 2022)
    recent_year: int = 2023
    recent_weight: float = 5.0
    base_weight: float = 1.0
    base_year: int = 2014
    period: float = WEEKS_PER_YEAR
    target_years: tuple[int, ...] = (2026, 2025, 2024)
    eval_year: int | None = None        # None = latest year present in the data
    week_window: tuple[int, int] = (1, 52)
    smoothing_window: int = 4
    top_causes: int = 5
    top_facilities: int = 10
    # Denominator of pooled rates: "row_sum" (sum over rows, as the source
    # system does) or "distinct_cell" (one population per area x year x age).
    denominator: str = "row_sum"
    # "training" (default; all training years) or "baseline" (baseline years
    # only, the documented variant) for the forecast Q3 threshold.
    threshold_years: str = "training"
    # Rows are dropped when *any* column is null (faithful default); set a
    # subset to drop only on those columns (documented variant).
    required_only: tuple[str, ...] | None = None

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


def surveillance_defaults() -> Config:
    return Config()


def driver_defaults() -> Config:
    """Parameters on the synthetic star-schema test tables (FIXTURES.md section 3)."""
    return Config(
        service="MAIN",
        excluded_causes=("PROMO",),
        spelling=(("MIDDLE EAST", "MIDDLE-EAST"),),
        age_columns=(
            ("n_automobile", "AUTOMOBILE"),
            ("n_building", "BUILDING"),
            ("n_furniture", "FURNITURE"),
            ("n_household", "HOUSEHOLD"),
            ("n_machinery", "MACHINERY"),
        ),
        drop_columns=(),
        cause_labels=(("ECONOMY", "Economy"), ("LARGE", "Large")),
        target_causes=("ECONOMY", "LARGE", "MEDIUM", "SMALL"),
        baseline_years=(1995, 1998),
        excluded_years=(1999,),
        recent_year=2000,
        base_year=1995,
        target_years=(2001,),
        eval_year=2001,
    )
