"""Fixed values of the domain: weights, thresholds, labels and lookup tables."""

# Weights of the score's indicators.
WEIGHTS = {
    "CAPITAL_SOCIAL_BAIXO": 15,
    "EMPRESA_RECENTE": 10,
    "SANCAO_HISTORICA": 5,
    "SOCIO_EM_MULTIPLAS_FORNECEDORAS": 20,
    "FORNECEDOR_EXCLUSIVO": 10,
    "CNAE_INCOMPATIVEL": 10,
    "MESMO_ENDERECO": 15,
    "CRESCIMENTO_SUBITO": 10,
    "SEM_FUNCIONARIOS": 10,
}
LOW_CAPITAL = 10_000
CONTRACTS_FOR_LOW_CAPITAL = 100_000
RECENT_DAYS = 6 * 30.44
MANY_COMPANIES = 3
GROWTH = 5
GROWTH_LEAST_ONLINE = 200_000
NEIGHBOURS_ONLINE = 2
# Alerts.
VERY_GRAVE, GRAVE = "GRAVISSIMO", "GRAVE"
SEVERITY = {
    "SOCIO_SERVIDOR_PUBLICO": VERY_GRAVE,
    "EMPRESA_SANCIONADA_CONTRATANDO": VERY_GRAVE,
    "DOACAO_PARA_CONTRATANTE": GRAVE,
    "SOCIO_SANCIONADO_EM_OUTRA": GRAVE,
    "RODIZIO_LICITACAO": VERY_GRAVE,
    "EMPRESA_DE_FACHADA": VERY_GRAVE,
}
MATERIAL_DONATION = 10_000
CONTRACTS_FOR_DONATION = 500_000
SHARED_BIDS = 3
FRONT_DAYS = 365
# Risk bands: least score and label, batch and online.
BANDS_BATCH = [(70, "Critico"), (50, "Alto"), (30, "Medio"), (10, "Baixo"), (0, "Minimo")]
BANDS_ONLINE = [(66, "Critico"), (41, "Alto"), (21, "Moderado"), (0, "Baixo")]
MOST_DEGREE = 100

# Activity codes by category.
ACTIVITY_CODES = {
    "TECNOLOGIA": ["6201-5", "6202-3", "6203-1", "6204-0", "6209-1", "6311-9", "6319-4", "6399-2"],
    "CONSTRUCAO": ["4110-7", "4120-4", "4211-1", "4212-0", "4213-8", "4221-9", "4222-7", "4291-0", "4292-8", "4299-5"],
    "COMERCIO_VAREJO": ["4711-3", "4712-1", "4713-0", "4721-1", "4722-9", "4731-8", "4741-5", "4742-3", "4744-0"],
    "SAUDE": ["8610-1", "8621-6", "8622-4", "8630-5", "8640-2", "8650-0", "8660-7", "4771-7", "4773-3"],
    "ALIMENTACAO": ["5611-2", "5612-1", "5620-1"],
    "LIMPEZA": ["8121-4", "8122-2", "8129-0"],
    "SEGURANCA": ["8011-1", "8012-0"],
    "CONSULTORIA": ["7020-4", "7490-1", "6920-6"],
    "EDUCACAO": ["8511-2", "8512-1", "8513-9", "8520-1"],
}
# What an activity category should not be contracted for.
INCOMPATIBLE = {
    "TECNOLOGIA": ["CONSTRUCAO", "SAUDE", "ALIMENTACAO", "LIMPEZA"],
    "COMERCIO_VAREJO": ["TECNOLOGIA", "CONSTRUCAO", "SAUDE", "SEGURANCA"],
    "CONSTRUCAO": ["TECNOLOGIA", "SAUDE", "ALIMENTACAO", "SEGURANCA"],
    "ALIMENTACAO": ["TECNOLOGIA", "CONSTRUCAO", "SEGURANCA"],
    "LIMPEZA": ["TECNOLOGIA", "CONSTRUCAO", "SAUDE"],
    "SEGURANCA": ["TECNOLOGIA", "CONSTRUCAO", "SAUDE", "ALIMENTACAO"],
    "CONSULTORIA": ["CONSTRUCAO", "SAUDE", "ALIMENTACAO", "LIMPEZA"],
    "EDUCACAO": ["CONSTRUCAO", "SAUDE", "LIMPEZA", "SEGURANCA"],
    "SAUDE": ["CONSTRUCAO", "ALIMENTACAO", "LIMPEZA", "SEGURANCA"],
}
# Key words of contract objects, first match in this order.
OBJECT_WORDS = {
    "TECNOLOGIA": ["software", "sistema", "ti ", "informatica", "computador", "rede", "dados"],
    "CONSTRUCAO": ["obra", "construcao", "reforma", "pavimentacao", "edificacao", "engenharia civil"],
    "SAUDE": ["medicamento", "hospitalar", "saude", "medico", "farmac", "laboratorio"],
    "ALIMENTACAO": ["alimentacao", "refeicao", "merenda", "alimento"],
    "LIMPEZA": ["limpeza", "conservacao", "higienizacao", "asseio"],
    "SEGURANCA": ["vigilancia", "seguranca patrimonial", "monitoramento eletronico"],
    "CONSULTORIA": ["consultoria", "assessoria", "auditoria"],
    "EDUCACAO": ["ensino", "treinamento", "capacitacao", "curso"],
}
