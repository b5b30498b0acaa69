"""The formula language: parser, column compiler, workbook evaluator, reference rewriting."""
