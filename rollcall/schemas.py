"""Column names and types of the registry tables. The names must equal the source system's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_LONG, _INT, _STR, _DATE = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


FAMILY = _struct(
    ("CO_FAMILIAR_FAM", _LONG),
    ("DT_CADASTRO_FAM", _DATE),
    ("DT_ULT_ATUAL_FAM", _DATE),
    ("CO_EST_CADASTRAL_FAM", _INT),
    ("IN_CADASTRO_VALIDO_FAM", _INT),
    ("CO_CONDICAO_CADASTRO_FAM", _INT),
    ("CO_MODALIDADE_OPER_FAM", _INT),
    ("CO_ORIGEM_FAMILIA_FAM", _INT),
    ("DT_CDSTR_ATUAL_FMLA", _DATE),
    ("IN_FAM_ALTERADA_V7", _INT),
    ("DT_ATUALIZACAO_FAM", _DATE),
    ("CO_MUNIC_IBGE_2_FAM", _INT),
    ("CO_MUNIC_IBGE_5_FAM", _INT),
    ("NO_LOCALIDADE_FAM", _STR),
)

PERSON = _struct(
    ("CO_CHV_NATURAL_PESSOA", _LONG),
    ("CO_FAMILIAR_FAM", _LONG),
    ("DT_CADASTRAMENTO_MEMB", _DATE),
    ("DT_ATUAL_MEMB", _DATE),
    ("CO_EST_CADASTRAL_MEMB", _INT),
    ("NO_PESSOA", _STR),
    ("NU_NIS_PESSOA", _STR),
    ("NO_APELIDO_PESSOA", _STR),
    ("DT_NASC_PESSOA", _DATE),
    ("CO_SEXO_PESSOA", _INT),
    ("CO_ORIGEM_FAMILIA_PESSOA", _INT),
    ("IN_ORIGEM_ALTERACAO_PESSOA", _INT),
    ("CO_CHV_NAT_PES_ATUAL", _LONG),
    ("CO_CHV_NAT_PES_ORIGINAL", _LONG),
    ("NU_NIS_ORIGINAL", _STR),
    ("IN_TRANSFERENCIA_PESSOA", _INT),
)

DOCUMENT = _struct(
    ("CO_CHV_NATURAL_PESSOA", _LONG),
    ("CO_FAMILIAR_FAM", _LONG),
    ("NU_CPF_PESSOA", _STR),
    ("CO_CERTIDAO_CIVIL_PESSOA", _STR),
    ("NO_CARTORIO_PESSOA", _STR),
    ("NU_IDENTIDADE_PESSOA", _STR),
    ("SG_UF_IDENT_PESSOA", _STR),
    ("NU_TITULO_ELEITOR_PESSOA", _STR),
)

SCHOOLING = _struct(
    ("CO_CHV_NATURAL_PESSOA", _LONG),
    ("CO_SABE_LER_ESCREVER_MEMB", _INT),
    ("IN_FREQUENTA_ESCOLA_MEMB", _INT),
    ("CO_CURSO_FREQUENTA_MEMB", _INT),
    ("CO_ANO_SERIE_FREQUENTA_MEMB", _INT),
    ("CO_CURSO_FREQ_PESSOA_MEMB", _INT),
    ("CO_ANO_SERIE_FREQUENTOU_MEMB", _INT),
)

CONTACT = _struct(
    ("CO_FAMILIAR_FAM", _LONG),
    ("NU_DDD_CONTATO_1_FAM", _STR),
    ("NU_TEL_CONTATO_1_FAM", _STR),
    ("NU_DDD_CONTATO_2_FAM", _STR),
    ("NU_TEL_CONTATO_2_FAM", _STR),
    ("IN_TIPO_EMAIL_FAM", _INT),
    ("DS_EMAIL_FAM", _STR),
)

EXCLUSION = _struct(
    ("CO_CHV_NATURAL_PESSOA", _LONG),
    ("DT_EXCLUSAO_PESSOA", _DATE),
    ("CO_MOTIVO_EXCLUSAO", _INT),
)

PAYROLL = _struct(("CO_FAMILIAR", _LONG), ("RF_FOLHA", _INT), ("NO_TIPO_SITIUACAO_BEN", _STR))
QUEUE = _struct(("CO_FAMILIAR", _LONG), ("RF_FOLHA", _INT))
PEOPLE_LIST = _struct(("NOME", _STR), ("CPF_RAW", _STR))

TABLES = {
    "TB_FAMILIA_01": FAMILY,
    "TB_PESSOA_04": PERSON,
    "TB_DOCUMENTO_05": DOCUMENT,
    "TB_ESCOLARIDADE_07": SCHOOLING,
    "TB_CONTATO_09": CONTACT,
    "TB_PESSOA_EXCLUIDA_19": EXCLUSION,
    "VW_FOLHA_PAGAMENTO": PAYROLL,
    "VW_PRE_HABILITACAO_PBF": QUEUE,
}


class MissingColumns(ValueError):
    """A source table lacks columns the library reads."""


def conform(df: DataFrame, schema: T.StructType, table: str = "table") -> DataFrame:
    """Check that every column of ``schema`` is there and cast those whose type differs.

    Columns that already have the right type are passed on untouched, so that filters on them still
    reach the Parquet scan.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in present]
    if missing:
        raise MissingColumns(f"{table} lacks {', '.join(missing)}")
    wanted = {f.name: f.dataType for f in schema.fields}
    if list(present.items()) == list(wanted.items()):
        return df
    return df.selectExpr(
        *[
            name if present[name] == kind else f"CAST({name} AS {kind.simpleString()}) AS {name}"
            for name, kind in wanted.items()
        ]
    )
