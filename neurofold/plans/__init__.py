"""Stages and their resumable orchestration."""
