import pytest

from parcela.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


LISTING_COLUMNS = (
    "execution_time url_propiedad portal tipo_propiedad operacion comuna barrio latitud longitud precio_uf m2_util m2_total dormitorios banios corredora "
    "codigo_interno url_plp posicion seller_thermometer estacionamiento bodega orientacion gastos_comunes piso anio titulo_propiedad images descripcion"
).split()


@pytest.fixture(scope="session")
def listings(spark):
    """A maker of listing tables: rows as dicts; what isn't given is null. Extra columns clash with names used inside of the operators."""

    extra = ("monto", "fecha", "uf_clp", "key", "run", "value", "at", "aviso", "lat", "lon", "values", "packed", "registro", "campo", "valor", "_chunk", "_at")

    def make(rows, clash=True):
        names = ["row_id", *LISTING_COLUMNS, *(extra if clash else ())]
        schema = ", ".join(["row_id long", *(f"{c} string" for c in names[1:])])
        full = [tuple([r.get("row_id", k + 1), *(r.get(c) if c in LISTING_COLUMNS else "x" for c in names[1:])]) for k, r in enumerate(rows)]
        return spark.createDataFrame(full, schema)

    return make
