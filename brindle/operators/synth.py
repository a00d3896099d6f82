"""A synthetic table of students by term, row by row from hashes of (seed, index, draw).

No draw depends on partitioning, so a row is the same in any plan.  The
distributions are fixed values; each is given with the column it makes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.columns import clip, period_order, round_even, uuid5

#: What the names of students begin with (fixed value).
NAME = "casei-v2-"
PROGRAMS = (("Ingenieria en Desarrollo de Software", 0.34, 270), ("Ingenieria Biomedica", 0.26, 282), ("Ingenieria en Energia", 0.22, 264), ("Ingenieria Agroindustrial", 0.18, 276))
PERIODS = (("2022-2", 0.08), ("2023-1", 0.15), ("2023-2", 0.18), ("2024-1", 0.22), ("2024-2", 0.20), ("2025-1", 0.17))
COHORTS = ((2020, 0.15), (2021, 0.22), (2022, 0.25), (2023, 0.23), (2024, 0.15))
EVENTS = (("normal", 0.67), ("enfermedad", 0.07), ("laboral", 0.09), ("recuperacion", 0.08), ("baja", 0.04), ("carga_extra", 0.05))


class Draws:
    """Named draws of one row."""

    def __init__(self, seed: int, index: Column) -> None:
        self.seed, self.index = seed, index

    def uniform(self, name: str, low: float = 0.0, high: float = 1.0) -> Column:
        x = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), self.index, F.lit(name)), 11).cast("double") * F.lit(2.0**-53)
        return F.lit(low) + x * F.lit(high - low)

    def normal(self, name: str, mean: Column | float = 0.0, sd: float = 1.0) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - self.uniform(name + "/r")))
        return (mean if isinstance(mean, Column) else F.lit(mean)) + F.lit(sd) * radius * F.cos(F.lit(2 * math.pi) * self.uniform(name + "/a"))

    def poisson(self, name: str, rate: Column | float, most: int = 40) -> Column:
        """Inverse of the distribution function, up to ``most``."""
        rate = rate if isinstance(rate, Column) else F.lit(rate)
        step = lambda s, i: F.struct((s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c"), (s["k"] + F.when(self_u > s["c"], 1).otherwise(0)).alias("k"))
        self_u = self.uniform(name)
        first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, step, lambda s: s["k"])

    def choice(self, name: str, options: Sequence[tuple]) -> Column:
        u, total, out = self.uniform(name), 1.0, F.lit(options[-1][0])
        for value, weight, *_ in reversed(options[:-1]):
            total = sum(o[1] for o in options[: options.index((value, weight, *_)) + 1])
            out = F.when(u < total, F.lit(value)).otherwise(out)
        return out


def whole(x: Column) -> Column:
    return F.rint(x).cast("int")


def students(spark: SparkSession, n: int = 1000, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``n`` rows of 38 columns; all data-quality rules hold."""
    return students_of(spark.range(0, n, 1, partitions).select(F.col("id").alias("index")), seed)


def students_of(df: DataFrame, seed: int = 42) -> DataFrame:
    """A student for each row of ``index`` (different integers); drawn from it alone, on any partitioning alike."""
    d = Draws(seed, F.col("index"))
    c = F.col
    plan = F.lit(PROGRAMS[-1][2])
    for name, _, credits in PROGRAMS[:-1]:
        plan = F.when(c("programa") == name, credits).otherwise(plan)
    event = lambda *names: c("event").isin(*names).cast("double")
    steps: list[dict[str, Column]] = [
        {"id_estudiante": uuid5(F.concat(F.lit(NAME), c("index").cast("string"))), "programa": d.choice("program", PROGRAMS), "id_periodo": d.choice("period", PERIODS), "cohorte": d.choice("cohort", COHORTS), "event": d.choice("event", EVENTS)},
        {"creditos_totales_plan": plan, "elapsed": F.greatest(F.lit(1), period_order(c("id_periodo")) - ((c("cohorte") - 1) * 2 + 1) + 1)},
        {"periodos_cursados": clip(whole(c("elapsed") + d.normal("elapsed", 0, 0.6)), 1, 12), "h": clip(d.normal("ability", 0.62, 0.18), 0.10, 0.98), "a": clip(d.normal("habit", 0.76, 0.18), 0.12, 0.99), "x": clip(d.normal("load", 0.28, 0.20), 0.0, 0.95)},
        {"s": clip(d.normal("support", 1 - c("h") + d.normal("support/in", 0, 0.10), 0.15), 0.0, 1.0)},
        {"progress": clip(F.least(F.lit(0.95), c("periodos_cursados") / 10) + 0.20 * (c("h") - 0.55) - 0.10 * c("s") - 0.06 * c("x") + d.normal("progress", 0, 0.06), 0.04, 0.98)},
        {"creditos_acumulados": clip(whole(c("creditos_totales_plan") * c("progress")), 0, c("creditos_totales_plan"))},
        {"materias_aprobadas": clip(whole(c("creditos_acumulados") / d.uniform("credit", 5, 8)), 0, 55), "porcentaje_avance": round_even(c("creditos_acumulados") / c("creditos_totales_plan") * 100), "carga": clip(F.floor(d.uniform("carga", 4, 8)).cast("int") + event("carga_extra").cast("int") - F.when(c("x") > 0.70, 1).otherwise(0), 2, 8)},
        {"inscritos": clip(whole(c("carga") * d.uniform("inscritos", 5, 8)), 8, 56), "att": 100 * clip(c("a") - 0.20 * c("x") - 0.20 * event("enfermedad", "laboral") + 0.08 * event("recuperacion") + d.normal("att", 0, 0.07), 0.05, 0.99)},
        {"permisos_aprobados": F.least(d.poisson("approved", 0.5 + 1.6 * c("x") + 2 * event("enfermedad", "laboral")), F.lit(8)), "permisos_rechazados": F.least(d.poisson("rejected", 0.2 + 0.8 * F.greatest(F.lit(0.0), 0.55 - c("a"))), F.lit(6))},
        {"faltas": clip(whole((100 - c("att")) / 100 * 32 - 0.45 * c("permisos_aprobados") + d.normal("faltas", 0, 2)), 0, 32), "retardos": F.least(d.poisson("late", 1 + 3 * (1 - c("a")) + c("x")), F.lit(12)), "general": 45 + 48 * c("h") + 8 * c("a") - 12 * c("s") + d.normal("general", 0, 5)},
        {"term": c("general") + d.normal("term", 0, 8) - 8 * c("x") + event("recuperacion") * d.uniform("up", 5, 12) - event("enfermedad", "laboral") * d.uniform("down", 5, 14)},
        {"promedio_general": round_even(clip(c("general"), 35, 98)), "promedio_periodo": round_even(clip(c("term"), 25, 100))},
        {"materias_reprobadas_periodo": F.least(d.poisson("failed", F.greatest(F.lit(0.05), (70 - c("promedio_periodo")) / 18 + (65 - c("att")) / 32)), c("carga"))},
        {"materias_reprobadas_acumuladas": F.least(c("materias_reprobadas_periodo") + d.poisson("failed/before", F.greatest(F.lit(0.2), c("s") * c("periodos_cursados") / 2.2)), F.lit(18))},
        {"recursamientos": F.when(c("materias_reprobadas_acumuladas") > 0, F.floor(d.uniform("retakes") * (c("materias_reprobadas_acumuladas") + 1)).cast("int")).otherwise(0), "periodos_sin_inscripcion": F.least(d.poisson("skipped", 0.12 + 0.35 * c("x") + 0.9 * event("baja")), F.lit(4))},
        {"rezago_materias": F.greatest(F.least(F.greatest(c("materias_reprobadas_acumuladas") - c("recursamientos"), F.lit(0)) + c("periodos_sin_inscripcion") + d.poisson("lag", 0.25 + 0.6 * c("s")), F.lit(12)), c("materias_reprobadas_acumuladas") - c("recursamientos"))},
        {"aprobados": clip(whole(c("inscritos") * F.greatest(F.lit(0.0), 1 - c("materias_reprobadas_periodo") / F.greatest(c("carga"), F.lit(1)))), 0, c("inscritos")), "tendencia_promedio": round_even(c("promedio_periodo") - c("promedio_general")), "varianza_calificaciones": round_even(clip(-10 * (F.log(1 - d.uniform("g1")) + F.log(1 - d.uniform("g2"))) + 25 * c("s"), 2, 85))},
        {"tutorias_abiertas": F.least(d.poisson("open", 0.3 + 1.8 * c("s") + 0.15 * c("rezago_materias")), F.lit(8)), "tutorias_cerradas": F.least(d.poisson("closed", 0.6 + 1.1 * (1 - c("s")) + 1.2 * event("recuperacion")), F.lit(8)), "num_asesorias": F.least(d.poisson("advice", 0.4 + 0.9 * c("materias_reprobadas_periodo") + c("s")), F.lit(10)), "num_incidencias": F.least(d.poisson("incidents", 0.15 + F.greatest(F.lit(0.0), 60 - c("att")) / 35 + 0.35 * c("permisos_rechazados")), F.lit(8))},
        {"compromisos_pendientes": F.least(d.poisson("pending", 0.2 + 0.7 * c("tutorias_abiertas") + 0.4 * c("num_incidencias")), F.lit(10)), "compromisos_cumplidos": F.least(d.poisson("met", 0.5 + 0.8 * c("tutorias_cerradas") + event("recuperacion")), F.lit(10))},
        {"risk": 0.04 * (70 - c("promedio_general")) + 0.025 * F.greatest(F.lit(0.0), 75 - c("att")) + 0.22 * c("materias_reprobadas_acumuladas") + 0.18 * c("rezago_materias") + d.normal("risk", 0, 0.35), "gone": (c("event") == "baja") | (c("periodos_sin_inscripcion") >= 2)},
        {"estatus_academico": F.when(c("gone"), "Baja Temporal").when(c("risk") > 2.0, "Irregular").otherwise("Regular"), "hidden": c("gone") & (d.uniform("hidden") < 0.55)},
    ]
    for step in steps:
        df = df.withColumns(step)
    zero = lambda x: F.when(c("gone"), F.lit(0)).otherwise(x)
    df = df.withColumns({
        "porcentaje_asistencia": round_even(F.when(c("gone"), c("att") * d.uniform("left", 0, 0.35)).otherwise(c("att"))), "faltas": F.when(c("gone"), clip(whole(d.normal("left/faltas", 24, 5)), 0, 32)).otherwise(c("faltas")),
        "materias_en_curso_periodo": zero(c("carga")), "creditos_inscritos_periodo": zero(c("inscritos")), "creditos_aprobados_periodo": zero(c("aprobados")),
        "promedio_periodo": F.when(~c("hidden"), c("promedio_periodo")), "tendencia_promedio": F.when(~c("hidden"), c("tendencia_promedio")), "bandera_dato_incompleto": c("hidden").cast("int"),
        "materias_reprobadas": c("materias_reprobadas_acumuladas"), "materias_en_curso": zero(c("carga")), "num_tutorias": c("tutorias_abiertas") + c("tutorias_cerradas"), "num_permisos": c("permisos_aprobados") + c("permisos_rechazados"),
    })
    from brindle.plans.students import COLUMNS

    return df.select(*COLUMNS)
