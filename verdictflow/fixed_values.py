"""Codes, labels, texts and limits that results must reproduce."""

# --- Labels of the coded attributes ------------------------------------------

ACCOUNT_STATUS = {
    "A11": "< 0 DM (Saldo Negativo)",
    "A12": "0 a 200 DM (Saldo Baixo)",
    "A13": ">= 200 DM (Saldo Alto)",
    "A14": "Sem conta corrente",
}

CREDIT_HISTORY = {
    "A30": "Sem créditos",
    "A31": "Créditos pagos neste banco",
    "A32": "Créditos pagos até agora",
    "A33": "Atrasos passados",
    "A34": "Conta crítica / Outros bancos",
}

LOAN_PURPOSE = {
    "A40": "Carro novo",
    "A41": "Carro usado",
    "A42": "Móveis/Equipamentos",
    "A43": "Rádio/Televisão",
    "A44": "Eletrodomésticos",
    "A45": "Reparos",
    "A46": "Educação",
    "A49": "Negócios",
    "A410": "Outros",
}

# --- Messages -----------------------------------------------------------------

LABEL_FIELD = "target_real"  # never shown to the model
ID_FIELD = "id_cliente"
ABSENT_FIELD = -1  # value of a label or id field the message does not have

# --- Verdicts -----------------------------------------------------------------

VALID_VERDICTS = frozenset({1, 2})
FAILED_VERDICT = 0
INVALID_VERDICT_TEXT = "predicao_invalida_recebida={}"
ERROR_TEXT = "erro: {} - {}"

# --- Limits -------------------------------------------------------------------

REQUEST_TIMEOUT_S = 30.0
OPERATOR_TIMEOUT_S = 120.0
MAX_IN_FLIGHT = 1
COMMIT_INTERVAL = "10 seconds"

# --- Prompt: the profile JSON follows directly -------------------------------

PROMPT = """Você é um analista de risco de crédito bancário experiente.

Ao avaliar um perfil, considere apenas estes fatores, nesta ordem de importância:
1. status_conta_corrente: saldo negativo ou ausência de conta é sinal de risco.
2. historico_credito: atrasos passados ou "conta crítica" são sinais de risco.
3. valor_credito_solicitado em relação a duracao_credito_meses: valores altos
com prazos longos aumentam o risco de inadimplência.
4. proposito_emprestimo: propósitos produtivos tendem a ser menos arriscados
que consumo quando combinados com outros sinais de risco.

Nunca compare o valor solicitado com preços de produtos ou serviços não
relacionados ao perfil. Baseie-se exclusivamente nos campos fornecidos.

Exemplo 1:
Perfil: {"status_conta_corrente": ">= 200 DM (Saldo Alto)", "duracao_credito_meses": 12, "historico_credito": "Créditos pagos neste banco", "proposito_emprestimo": "Educação", "valor_credito_solicitado": 1500}
Resposta: {"predicao": 1, "justificativa": "Saldo alto e histórico de créditos pagos neste banco indicam baixo risco."}

Exemplo 2:
Perfil: {"status_conta_corrente": "< 0 DM (Saldo Negativo)", "duracao_credito_meses": 48, "historico_credito": "Atrasos passados", "proposito_emprestimo": "Carro novo", "valor_credito_solicitado": 9500}
Resposta: {"predicao": 2, "justificativa": "Saldo negativo, atrasos passados e valor alto em prazo longo indicam alto risco."}

Agora avalie o perfil abaixo. Responda APENAS in JSON com os campos "predicao" (1 ou 2) e "justificativa":
Perfil: """
